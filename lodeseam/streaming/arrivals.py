"""Files as they arrive: an extra beside the batch engine, for folders that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.detect import detect
from lodeseam.plans.options import DEFAULTS, ScanOptions

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_arrivals(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """A stream of the objects of new files."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", most_files).load(path)
    return files.select(F.xxhash64("path").alias("object_id"), "path", "modificationTime", "length", "content")


def counts(arrivals: DataFrame, options: ScanOptions = DEFAULTS, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Objects and bytes by format and window of the files' times; files later than `late` no longer count."""
    rows = arrivals.withWatermark("modificationTime", late).withColumn("format", detect(F.col("content"), options.formats)["format"])
    grouped = rows.groupBy(F.window("modificationTime", width), "format")
    return grouped.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
