"""Binary objects as rows: files, tables, and streams behind callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a callback stream that are asked for at once, and objects over this size that become an error row.
CHUNK, MOST = 32768, 1 << 30


def read_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """object_id, path, modificationTime, length, content of files.  The id is a hash of the path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    files = reader.load(path)
    return files.select(F.xxhash64("path").alias("object_id"), "path", "modificationTime", "length", "content")


def objects_from(df: DataFrame, content: Column, key: Column, name: Column | None = None) -> DataFrame:
    """A table's BINARY column as objects."""
    path = F.lit(None).cast("string") if name is None else name
    return df.select(
        key.cast("long").alias("object_id"), path.alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"),
        F.octet_length(content).cast("long").alias("length"), content.alias("content"),
    )


def payload(text: Column, hex_digits: Column) -> Column:
    """UTF-8 text behind leading bytes."""
    return F.concat(F.unhex(hex_digits), F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def object_size(spark: SparkSession, path: str) -> int:
    """A file's length, or -1 if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getLen() if fs.exists(at) else -1


class _Stream(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class _CallbackReader(DataSourceReader):
    def __init__(self, openers: list[Callable]):
        self.openers = openers

    def partitions(self):
        return [_Stream(k) for k in range(len(self.openers))]

    def read(self, partition: InputPartition):
        read = self.openers[partition.value]()
        if read is None:
            yield partition.value, None, None, None, None
            return
        parts = []
        while part := read(CHUNK):
            parts.append(part)
        content = b"".join(parts)
        yield partition.value, None, None, len(content), content


class _CallbackWriter(DataSourceWriter):
    def __init__(self, put: Callable, done: Callable | None):
        self.put, self.done = put, done

    def write(self, rows) -> WriterCommitMessage:
        for r in rows:
            self.put(r.asDict())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        if self.done:
            self.done()

    def abort(self, messages) -> None:
        pass


def callback_source(name: str, openers: list[Callable[[], Callable[[int], bytes] | None]], put: Callable[[dict], None] | None = None, done: Callable[[], None] | None = None) -> type[DataSource]:
    """A data source over streams: each opener gives a read(size) function, or None for no stream; put takes written rows.

    Register it with `spark.dataSource.register`, then use `spark.read.format(name)` and `df.write.format(name)`.
    """

    class Callbacks(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "object_id bigint, path string, modificationTime timestamp, length bigint, content binary"

        def reader(self, schema) -> DataSourceReader:
            return _CallbackReader(openers)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if put is None:
                raise ValueError("the source can't be written")
            return _CallbackWriter(put, done)

    return Callbacks


def checked(objects: DataFrame, most: int = MOST) -> DataFrame:
    """objects with error: (code, message) where content is missing or too large, which then is null."""
    size = F.octet_length("content")
    error = F.when(F.col("content").isNull(), F.struct(F.lit(1).alias("code"), F.lit("no content").alias("message"))).when(
        size > most, F.struct(F.lit(21).alias("code"), F.format_string("%d bytes", size).alias("message"))
    )
    return objects.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
