"""URL filters by a temporal list join, in DataFrame operations alone.

Dated list entries (domain, action, since) become validity intervals: an entry holds from its date until the next
entry of its domain.  A capture is evaluated as of its fetch time against the entries active then for its host and
every parent domain of it; the most specific one decides.  Captures are first reduced to distinct (host, fetch day), so
a host with a third of all captures is at most one row a day in the join.  Verdicts are joined back by a hash of host
and day that they aren't dealt by, so that a host's captures of one day can be split like any skewed key.

Defined results: a null or hostless URL, or a null fetch time, matches nothing and is allowed; of entries with the same
domain and date the last action by name holds; entries with a null domain, date or action are no entries; repeated
captures are rows of their own; other columns pass through `apply` unless they have the names of its results, which then
replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    """The lower-case host of an http(s) URL, without user, port and final dot; null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    found = F.regexp_replace(found, r"\.$", "")
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, action, since, until (null: still active) of each entry."""
    known = entries.filter("domain IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL")
    known = known.groupBy(F.lower("domain").alias("domain"), F.col("since").cast("date").alias("since")).agg(F.max("action").alias("action"))
    return known.withColumn("until", F.lead("since").over(Window.partitionBy("domain").orderBy("since")))


def parents(name: Column) -> Column:
    """A host and each of its parent domains, the most specific first."""
    parts = F.split(name, r"\.")
    size = F.size(parts)
    return F.transform(F.sequence(F.lit(1), size), lambda k: F.array_join(F.slice(parts, k, size - k + 1), "."))


def apply(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, domain (the entry's), action, since and blocked."""
    results = {"host", "domain", "action", "since", "blocked"}
    kept = [F.col(f"`{c}`") for c in captures.columns if c.lower() not in results]
    row = F.struct(*kept) if kept else F.struct(F.lit(0))
    rows = captures.select(row.alias("row"), host(F.col(url)).alias("host"), F.col(fetched).cast("date").alias("day"))
    distinct = rows.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    # Few rows a host and day: as many as it has labels.
    asked = distinct.select("host", "day", F.explode(parents(F.col("host"))).alias("name"))
    lists = intervals(entries)
    active = (F.col("name") == F.col("domain")) & (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    found = asked.join(lists, active).groupBy("host", "day")
    found = found.agg(F.max_by(F.struct("domain", "action", "since"), F.length("domain")).alias("entry"))
    place = F.xxhash64("host", "day").alias("place")
    out = rows.select("*", place).join(found.select("*", place), ["place", "host", "day"], "left")
    return out.select(
        *([F.col("row.*")] if kept else []),
        "host",
        F.col("entry.domain").alias("domain"),
        F.col("entry.action").alias("action"),
        F.col("entry.since").alias("since"),
        F.coalesce(F.col("entry.action") == BLOCK, F.lit(False)).alias("blocked"),
    )
