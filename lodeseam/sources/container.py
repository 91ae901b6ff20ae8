"""Containers: what a scan found, as three Parquet tables from which every object is made again bit by bit.

manifest: a row an object (its id, path, length, checksum, and whether anything of it is expanded); streams: a row a
stream with its place and parameters; payloads: a row a stream with its content, and one an object with what they leave.  Metadata and bytes are apart, so that questions
about streams never read content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.operators import streams

MAGIC, VERSION = "PCF", 1


class ContainerError(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def write(scanned: DataFrame, path: str) -> None:
    """scanned: what `streams.scan` gives with residues, a number object_row for each object, its id and path."""
    whole, own = scanned.filter("format IS NULL"), scanned.filter("accepted")
    about = [F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), "object_row", "object_id", "path"]
    expanded = F.coalesce(F.octet_length("content") < F.col("compressed_size"), F.lit(False)).alias("expanded")
    own.drop("content", "header", "error", "path").write.parquet(f"{path}/streams")
    scanned.filter("accepted OR format IS NULL").select("object_row", "offset", "content").write.parquet(f"{path}/payloads")
    whole.select(*about, F.col("compressed_size").alias("length"), "crc32", expanded).write.parquet(f"{path}/manifest")  # last: a container without one isn't whole


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; an error if it isn't one of ours."""
    manifest = spark.read.parquet(f"{path}/manifest")
    found = {(r[0], r[1]) for r in manifest.select("magic", "version").distinct().limit(2).collect()} if {"magic", "version"} <= set(manifest.columns) else {("", 0)}
    if any(m != MAGIC for m, _ in found):
        raise ContainerError(20, "Input stream has no valid PCF header")
    if any(v != VERSION for _, v in found):
        raise ContainerError(21, "Input stream was made with an incompatible version")
    return manifest


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """object_id, path, content and verified of every object of a container."""
    manifest = read_header(spark, path)
    payloads, found = spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/streams").drop("object_id")
    made = found.join(payloads.filter("offset IS NOT NULL"), ["object_row", "offset"])
    made = made.select("object_row", F.struct("segments", streams.repacked(made).alias("packed")).alias("stream"))
    # An object's streams meet again in its row: no more than its own bytes.
    own = made.groupBy("object_row").agg(F.collect_list("stream").alias("streams"))
    rows = manifest.join(payloads.filter("offset IS NULL").drop("offset"), "object_row").join(own, "object_row", "left")
    rows = rows.withColumn("content", F.when(F.col("expanded"), streams.spliced(F.col("content"), F.col("streams"))).otherwise(F.col("content")))
    verified = F.octet_length("content").cast("long").eqNullSafe(F.col("length")) & F.crc32("content").eqNullSafe(F.col("crc32"))
    return rows.select("object_id", "path", "content", verified.alias("verified"))
