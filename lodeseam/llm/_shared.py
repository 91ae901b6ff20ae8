"""Where the operators of this subpackage keep tables that more than one job reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch: a thousand documents are a few MB, and a thousand very long ones still fit a worker.
ARROW_ROWS = 1000
#: Files of a small table at most, and small rows of a file beyond that.
FILES, FILE_ROWS = 16, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on one machine where the setting is absent (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodeseam-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """df with its lineage cut: its rows lie in the shared folder, so a lost executor costs nothing.

    rows: how many small rows df has about, where that is known; they lie in as few files as that needs (each file costs
    processes where Hadoop has no native library).  dealt: the rows are dealt to the files by a shuffle, so that what
    makes them keeps its tasks.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        files = max(FILES, rows // FILE_ROWS)
        df = df.repartition(files) if dealt else df.coalesce(files)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path for `remove`."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name), compression="zstd")
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for two Python workers beside an executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
