"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers in the order of doc_id (null first, equal ids by the size and checksum of the text), from a range
partitioned sort: each partition numbers its own rows and the partitions' counts are summed up.  A keyed Feistel
network over just enough bits permutes [0, n); a value outside is encrypted again until it falls inside (cycle
walking), so the result is a permutation of exactly n numbers.  Number p goes to shard p mod k, slot p div k: shards'
counts are at most one apart and slots have no gaps.  `locate` and `occupant` compute the place of a row number and
the row number at a place without any table.

Defined results: a null text has size 1 and the checksum of the empty text; rows with a null or repeated doc_id are
rows of their own (equal rows are interchangeable); an empty table gives no rows; other columns pass through `place`
unless they have the names of its results, which then replace them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm._shared import written
from lodeseam.llm._text import mixed

ROUNDS, SEED = 8, 20_240_229
#: Rows that a partition of monotonically_increasing_id can number.
_PID_BITS = 33


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _round(value: np.ndarray, k: int, seed: int) -> np.ndarray:
    return mixed(value + mixed(np.array([seed * 1_000_003 + k], np.uint64)))


def _forward(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    low, high = _halves(n)
    for k in range(ROUNDS):  # the halves change places, and widths, each round
        left, right = x >> np.uint64(high), x & np.uint64((1 << high) - 1)
        x = (right << np.uint64(low)) | (left ^ (_round(right, k, seed) & np.uint64((1 << low) - 1)))
        low, high = high, low
    return x


def _backward(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    low, high = _halves(n)
    if ROUNDS % 2:
        low, high = high, low
    for k in reversed(range(ROUNDS)):
        low, high = high, low
        right, left = x >> np.uint64(low), x & np.uint64((1 << low) - 1)
        x = ((left ^ (_round(right, k, seed) & np.uint64((1 << low) - 1))) << np.uint64(high)) | right
    return x


def permute(rows: np.ndarray, n: int, seed: int = SEED, backward: bool = False) -> np.ndarray:
    """The place of each row number in a permutation of [0, n), or the row number at each place."""
    step = _backward if backward else _forward
    out = step(rows.astype(np.uint64), n, seed)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = step(out[far], n, seed)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def occupant(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, backward=True)[0])


def place(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """docs and size, text_crc32, row_number, shard and slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = {
        "size": F.octet_length(text).cast("long") + 1,
        "text_crc32": F.crc32(text.cast("binary")),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*own, "row_number", "shard", "slot"}]
    order = ["row.doc_id", "size", "text_crc32"]
    # Numbered as it is written: what is read back can't be dealt out in another way.
    sized = docs.select(F.struct(*kept).alias("row"), *(v.alias(k) for k, v in own.items()))
    numbered = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = written(numbered, "sharding")[0]
    part = F.shiftright("at", _PID_BITS).cast("int")
    counts = {r[0]: r[1] for r in numbered.groupBy(part.alias("p")).count().collect()}  # a count for each partition
    n, before = 0, {}
    for p in sorted(counts):
        before[p], n = n, n + counts[p]
    places = docs.sparkSession.sparkContext.broadcast(before)

    @F.arrow_udf("struct<row_number: long, shard: int, slot: long>")
    def dealt(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        parts, which = np.unique(at >> _PID_BITS, return_inverse=True)
        rows = np.array([places.value[int(p)] for p in parts], np.int64)[which] + (at & ((1 << _PID_BITS) - 1))
        to = permute(rows, n, seed)
        columns = [pa.array(rows), pa.array((to % shards).astype(np.int32)), pa.array(to // shards)]
        return pa.StructArray.from_arrays(columns, ["row_number", "shard", "slot"])

    return numbered.withColumn("at", dealt("at")).select("row.*", *own, "at.row_number", "at.shard", "at.slot")
