"""The engine: objects in, streams expanded and verified, containers out and back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.detect import is_container
from lodeseam.operators import lineage, streams
from lodeseam.plans.options import ScanOptions
from lodeseam.sources import container, objects


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    options: ScanOptions = field(default_factory=ScanOptions)

    def read(self, source: str | DataFrame) -> DataFrame:
        """Objects from a path or a table that has object_id and content."""
        return objects.read_objects(self.spark, source) if isinstance(source, str) else source

    def detect(self, source: str | DataFrame, inside: bool = False) -> DataFrame:
        return lineage.candidates(self.read(source), self.options, inside=inside)

    def precompress(self, source: str | DataFrame) -> DataFrame:
        """The outermost streams of each object, wherever they stand, expanded, with the parameters that give back their bytes.

        accepted: the stream was made again bit by bit while it was scanned; what can't be is kept as it is.
        """
        found = streams.scan(self.read(source), ["object_id"], self.options)
        parent = F.xxhash64(F.lit("object"), "object_id")
        # Cut: what reads it filters by these columns and reads it twice.
        return lineage.cut(found.select(
            F.xxhash64(F.lit("stream"), parent, "offset").alias("stream_id"), "object_id", F.lit(None).cast("long").alias("parent_stream_id"),
            F.lit(1).alias("depth"), *streams.COLUMNS, F.col("accepted").alias("verified"),
        ))

    def expand(self, source: str | DataFrame, search: bool = False) -> DataFrame:
        """Streams inside streams, to the depth limit."""
        return lineage.expand_all(self.read(source), self.options, search=search)

    def write_container(self, source: str | DataFrame, path: str) -> None:
        """Three tables that hold every object, row by row, whatever ids repeat."""
        own = self.read(source)
        own = own if "path" in own.columns else own.withColumn("path", F.lit(None).cast("string"))
        numbered = own.select(F.monotonically_increasing_id().alias("object_row"), "object_id", "path", "content")
        # Cut: rows keep their numbers however often they are read.
        container.write(lineage.cut(streams.scan(numbered, ["object_row", "object_id", "path"], self.options, residue=True)), path)

    def recompress(self, path: str) -> DataFrame:
        return container.rebuild(self.spark, path)

    def operation(self, source: str | DataFrame) -> DataFrame:
        """object_id and what is to be done with it: containers are rebuilt, anything else is expanded."""
        return self.read(source).select("object_id", F.when(is_container(F.col("content")), "recompress").otherwise("precompress").alias("operation"))

    def statistics(self, found: DataFrame) -> DataFrame:
        return lineage.statistics(found, self.options)
