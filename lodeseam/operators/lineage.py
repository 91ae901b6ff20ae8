"""Streams inside objects: candidates, the loop that expands them level by level, and statistics over what it found."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.detect import detect
from lodeseam.functions.registry import ID
from lodeseam.operators import streams
from lodeseam.operators.walkers import EmbeddedHeaders
from lodeseam.plans.options import DEFAULTS, ScanOptions

def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder that all executors share."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='lodeseam-')}")
    return df.checkpoint()


def candidates(objects: DataFrame, options: ScanOptions = DEFAULTS, key: str = "object_id", content: str = "content", inside: bool = True) -> DataFrame:
    """(key, offset, format, confidence): what an object is, and with `inside` what stands in it further on."""
    c = F.col(content)
    whole = objects.select(key, F.lit(0).cast("long").alias("offset"), detect(c, options.formats).alias("d")).filter("d.is_match")
    whole = whole.select(key, "offset", F.col("d.format").alias("format"), F.col("d.confidence").alias("confidence"))
    if not inside:
        return whole
    enabled = [ID[f] for f in options.formats]
    found = objects.lateralJoin(EmbeddedHeaders(c.outer()))
    return whole.unionByName(found.select(key, "offset", "format", "confidence").filter(F.col("format").isin(enabled)))


def without_ignored(rows: DataFrame, ignored: DataFrame, on: str = "offset") -> DataFrame:
    """rows whose offset isn't listed."""
    return rows.join(ignored.select(on).distinct(), on, "left_anti").select(rows.columns)


def greedy(rows: DataFrame, key: str = "object_id") -> DataFrame:
    """Of overlapping streams [offset, offset + length) of an object those that a scan from the left takes.

    A stream is taken if it begins at or after the end of the last taken one; of those that begin together the longest.
    """
    each = F.struct("offset", (-F.col("length")).alias("_l"), F.struct(*rows.columns).alias("row"))
    kind = rows.schema.simpleString()
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast(f"array<{kind}>").alias("taken"))
    free = lambda s, x: (x["offset"] >= s["end"]) & (x["_l"] < 0)
    step = lambda s, x: F.when(
        free(s, x), F.struct((x["offset"] - x["_l"]).alias("end"), F.concat(s["taken"], F.array(x["row"].cast(kind))).alias("taken"))
    ).otherwise(s)
    chosen = F.aggregate("_all", start, step, lambda s: s["taken"])
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("_all"))
    return grouped.select(F.inline(chosen))


def long_enough(identical: Column, options: ScanOptions) -> Column:
    """Strictly more than the least number of identical bytes."""
    return identical > options.min_identical


def expand_all(objects: DataFrame, options: ScanOptions = DEFAULTS, key: str = "object_id", search: bool = False) -> DataFrame:
    """Streams of objects at any place, what they hold scanned in turn, to the depth limit or until nothing is a stream.

    A row a stream: stream_id, object_id, parent_stream_id, depth and the columns of `streams.scan`; accepted is null
    unless parameters are searched.  A stream's id is a hash of its parent's and its place, an object's one of its id and
    content, so that a level that is computed again gives the same ids and equal object_ids stay apart.  Each level is
    cut off in the shared folder; its size is what the next one works on.
    """
    level = objects.select(F.col(key).alias("object_id"), F.xxhash64(F.lit("object"), key, "content").alias("stream_id"), "content")
    out, depth = None, 0
    while options.max_depth is None or depth < options.max_depth:
        depth += 1
        own = streams.scan(level, ["object_id", "stream_id"], options, search, depth=depth)
        about = [F.xxhash64(F.lit("stream"), "stream_id", "offset").alias("stream_id"), "object_id", F.col("stream_id").alias("parent_stream_id"), F.lit(depth).alias("depth")]
        accepted = F.col("accepted") if search else F.lit(None).cast("boolean")
        own = cut(own.select(*about, *(accepted.alias(c) if c == "accepted" else c for c in streams.COLUMNS)))
        out = own if out is None else out.unionByName(own)
        level = own.filter("content IS NOT NULL").select("object_id", "stream_id", "content")
        if level.isEmpty():
            break
    if out is None:
        raise ValueError("a depth limit of 0 expands nothing")
    return out


def statistics(found: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """A row a format: decompressed_count, recompressed_count (accepted), deepest, limit_reached, last_level."""
    limit = F.lit(False) if options.max_depth is None else F.col("depth") >= options.max_depth
    return found.groupBy("format").agg(
        F.count_if(F.col("uncompressed_size").isNotNull()).alias("decompressed_count"),
        F.count_if("accepted").alias("recompressed_count"),
        F.max("depth").alias("deepest"),
        F.bool_or(limit).alias("limit_reached"),
        F.max_by("level", F.struct("object_id", "depth")).alias("last_level"),
    )


def usage(found: DataFrame) -> DataFrame:
    """One row: whether anything was used, and whether anything but zlib streams was."""
    return found.agg(
        F.coalesce(F.bool_or("accepted"), F.lit(False)).alias("anything_was_used"),
        F.coalesce(F.bool_or(F.col("accepted") & ~F.col("format").isin(ID["ZLIB"], ID["GZIP"], ID["ZIP"], ID["SWF"])), F.lit(False)).alias("non_zlib_was_used"),
    )


def wide(stats: DataFrame, names: dict[int, str]) -> DataFrame:
    """The statistics as one row, a column for each format and count."""
    pivoted = stats.groupBy().pivot("format", sorted(names)).agg(F.max("decompressed_count").alias("decompressed"), F.max("recompressed_count").alias("recompressed"))
    return pivoted.select(*(F.coalesce(F.col(f"`{k}_{w}`"), F.lit(0)).alias(f"{names[k].lower()}_{w}") for k in sorted(names) for w in ("decompressed", "recompressed")))


def last_level(rows: DataFrame, key: str = "object_id") -> DataFrame:
    """The level of the stream that stands last in each object."""
    return rows.groupBy(key).agg(F.max_by("level", "offset").alias("level"))
