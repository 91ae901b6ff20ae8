"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Targets: a source's share of the mix by its weight, no more than `most` times its size; the excess goes to the others
by weight until none is above.  That is a common level L with target = min(cap, L * weight), found with sources in the
order of cap / weight from running sums over the sources.

Sampling: a source first gives floor(target / size) complete epochs.  What is missing comes from a fractional epoch:
each document draws u in (0, 1) from a hash and has the exponential key -ln(u) / quality; documents are taken in the
order of their keys while the running sum of their sizes keeps to the budget.  The running sum is two-level: keys
fall into ranges of u^(1/quality), about GROUPS_A_BUCKET rows each and more of them the more rows there are, bucket sums
are added up for each source, and only inside a bucket rows are sorted, so no task ever holds a source.  A document that
straddles the budget is taken if more than half of it fits.

Equal rows (in all columns) draw the same key and are one row with a count here, so that any number of them is no load;
of n of them the running sum takes as many as fit.

Defined results: a null source is a source of its own, last in the order; a null text has size 0 and is taken 0 words;
equal rows are interchangeable; if all texts are empty, all targets are 0; an empty table gives no rows; all columns
pass through `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm._shared import cut

#: Ranges of keys in a source at least, and rows of one about.
BUCKETS, GROUPS_A_BUCKET = 1024, 250_000
WEIGHTS, BUDGET, MOST, SEED = (3, 1, 2), 1.5, 2.0, 17


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From 0.5 to 1: more for texts with a smaller part of characters that prose rarely has."""
    t = F.coalesce(text, F.lit(""))
    odd = F.length(t) - F.length(F.translate(t, "#*$%&|<>{}[]\\^~_=@", ""))
    return 1 - 0.5 * F.least(F.lit(1.0), 4.0 * odd / F.greatest(F.length(t), F.lit(1)))


def row_key(docs: DataFrame) -> Column:
    """192 bits that equal rows share, the first 128 of them by doc_id, source and text alone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    known = F.md5(F.concat_ws("\x1f", part("doc_id"), part("source"), F.md5(part("text"))))
    rest = [F.col(f"`{f.name}`") for f in docs.schema if f.name.lower() not in ("doc_id", "source", "text") and "map<" not in f.dataType.simpleString()]
    return F.concat(known, F.hex(F.xxhash64(F.lit(0), *rest)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size to which `target` is added.  A row a source: running sums over them run in one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    caps = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn))
    caps = caps.withColumn("cap", most * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    levels = caps.select(
        "*",
        (budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.row_number().over(filling).alias("k"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"),
    )
    # The first source below its cap sets the level of all from it on.
    below = F.col("left") / F.col("weights") < F.col("cap") / F.col("weight")
    level = F.min(F.when(below, F.struct("k", (F.col("left") / F.col("weights")).alias("level")))).over(whole)
    out = levels.withColumn("level", level["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return out.select("source", "source_size", target.alias("target"))


def _drawn(docs: DataFrame, weights: tuple[float, ...], budget: float, most: float, seed: int) -> DataFrame:
    """Of each group of equal rows: row_key, doc_id, size, source_size, target, n (rows), full (times that each is taken
    at least) and more (rows that are taken once more)."""
    text = F.col("text").cast("string")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.substring("row_key", 1, 32)), 11) + 0.5) / float(1 << 53)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), row_key(docs).alias("row_key"), quality(text).alias("quality"))
    same = [F.min(c).alias(c) for c in ("doc_id", "source", "size", "quality")]
    groups = cut(rows.groupBy("row_key").agg(*same, F.count("*").alias("n")).withColumn("key", -F.log(u) / F.col("quality")))  # read three times
    buckets = max(BUCKETS, groups.count() // GROUPS_A_BUCKET)
    groups = groups.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key")))).cast("long")).withColumn("words", F.col("size") * F.col("n"))
    held = groups.groupBy("source", "bucket").agg(F.sum("words").alias("held"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("source", "bucket", F.coalesce(F.sum("held").over(running), F.lit(0)).alias("before"))
    sources = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    # A row for each source and bucket, whatever the number of documents.
    known = held.join(sources, held["source"].eqNullSafe(sources["source"])).select(held["source"].alias("s"), held["bucket"].alias("b"), "before", "source_size", "target")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce("inside", F.lit(0))
    part = F.col("target") - F.col("full") * F.col("source_size")
    # Copy j is taken if ahead + j * size + size / 2 < part.
    fit = F.when(F.col("size") > 0, F.ceil((part - ahead) / F.col("size") - 0.5)).otherwise(F.when(ahead < part, F.col("n")).otherwise(0))
    return (
        groups.withColumn("inside", F.sum("words").over(inside))
        .join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("full", full)
        .select("row_key", "doc_id", "source", "size", "source_size", "target", "n", "full", F.least("n", F.greatest(F.lit(0), fit)).cast("long").alias("more"))
    )


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """A narrow row a document: doc_id, source, row_key, size, source_size, target, epochs (times it is taken), taken."""
    drawn = _drawn(docs, weights, budget, most, seed).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    drawn = drawn.withColumn("epochs", (F.col("full") + (F.col("j") < F.col("more")).cast("long")).cast("long"))
    return drawn.select("doc_id", "source", "row_key", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with docs' columns.

    Rows meet their group by the reverse of its key, which the groups aren't dealt by: both sides of the join then have
    an exchange, so that skew can be split.  Where some of a group's equal rows are taken once more, one of them stands
    for these (at most one group a source).
    """
    drawn = cut(_drawn(docs, weights, budget, most, seed).select(F.reverse("row_key").alias("key"), "n", "full", "more"))
    rows = docs.select(F.reverse(row_key(docs)).alias("key"), F.struct("*").alias("row"))
    times = F.col("full") + (F.col("more") == F.col("n")).cast("long")
    taken = rows.join(drawn.select("key", times.alias("times")).filter("times > 0"), "key")
    straddling = drawn.filter("more > 0 AND more < n").select("key", F.col("more").alias("times"))
    again = rows.join(straddling, "key").dropDuplicates(["key"])
    every = taken.select("row", "times").union(again.select("row", "times"))
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
