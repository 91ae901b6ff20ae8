"""Substring dedup by level-wise doubling of repeated windows.

Levels are window lengths that double (9, 18, 35 words for the final length 35; the last two halves overlap by a word).
Every final window has a place for each level that hangs on its words alone: at the first, its short window with the
smallest hash (its anchor, about a tenth of all windows are one); at the next, the window of twice the length that
begins at the anchor, or ends with it where that would go beyond the final window.  Equal final windows have equal
windows at equal offsets on each level.  Level by level, windows that occur once end there and those that are repeated
alone are extended to twice their length, until none survives or the final length is reached.  There, where all
occurrences of a window have the same words in all final windows around it, they are all repeated and need no look at
single windows; elsewhere (the ends of shared passages, changed words) each final window is counted by its own hash.

Texts cross the network once, by a hash of the row, to meet their flags; windows do as hashes.  Counts are combined
before the shuffle and joined back by the complement, so that a passage in a third of all documents, or a row that is
repeated so often, is split like any skewed key.

Defined results: a null or short text has no window and keeps its words; copies, and repeated rows, lose all words that
a window covers, every one of them; rows with a null doc_id are rows of their own; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm._shared import cut, remove, small_batches, written
from lodeseam.llm._text import mixed, ranges, split, starts, steps, window_hashes, word_hashes

WINDOW = 35
#: Words of the first level at least.
SHORTEST = 8


def lengths(window: int = WINDOW) -> list[int]:
    """Window lengths below the final one, each half of the next, rounded up."""
    out = [(window + 1) // 2]
    while out[-1] > 2 * SHORTEST:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each `width` consecutive values is, the first of equals."""
    n = len(values) - width + 1
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        size += step
    return at[:n]


class Groups:
    """The final windows of a flat array of words, in groups of consecutive ones with the same places on all levels.

    owner: the document; begin, end: the first and last window of the group; levels: the hash of the window of each
    level; new: whether the group is the first with its window of each level; around: a hash of all words under the
    group's windows and of where the last level's window lies; full: the hash of each final window.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW):
        sizes = lengths(window)
        at, n_windows = starts(counts), np.maximum(counts - window + 1, 0)
        self.full = window_hashes(hashes, window)
        begins = ranges(at[:-1], n_windows)
        docs = np.repeat(np.arange(len(counts)), n_windows)
        if not len(begins):
            self.owner = self.begin = self.end = begins
            self.around, self.levels, self.new = np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * len(sizes), [np.zeros(0, bool)] * len(sizes)
            return
        short = window_hashes(hashes, sizes[0])
        places = [_leftmost_least(short, window - sizes[0] + 1)[begins]]
        for small, size in zip(sizes[:-1], sizes[1:], strict=True):
            fits = places[-1] + size <= begins + window
            places.append(np.where(fits, places[-1], places[-1] + small - size))
        other = docs[1:] != docs[:-1]
        moved = [np.concatenate(([True], other | (p[1:] != p[:-1]))) for p in places]
        first = np.flatnonzero(np.logical_or.reduce(moved))
        last = np.append(first[1:], len(begins)) - 1
        self.owner, self.begin, self.end = docs[first], begins[first], begins[last]
        self.levels = [short[places[0][first]], *(window_hashes(hashes, n)[p[first]] for n, p in zip(sizes[1:], places[1:], strict=True))]
        self.new = [m[first] for m in moved]
        # The first and the last window overlap, so they tell all words between.
        where = ((self.end - self.begin) * window + (places[-1][first] - self.begin)).astype(np.uint64)
        both = self.full[self.begin] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(self.full[self.end] + np.uint64(1))
        self.around = mixed(both + mixed(where))

    @property
    def anchor(self) -> np.ndarray:
        """The window of the last level."""
        return self.levels[-1]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Of each group of windows: rid, the window h0, h1, ... of each level, new (a bit a level) and around."""
    names = [f"h{k}" for k in range(len(lengths(window)))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                words, counts = split(step.column("text"))
                found = Groups(word_hashes(words), counts, window)
                rid = step.column("rid").to_numpy(zero_copy_only=False)[found.owner]
                new = sum(n.astype(np.int8) << k for k, n in enumerate(found.new))
                columns = [pa.array(c.view(np.int64)) for c in (rid, *found.levels, found.around)]
                yield pa.record_batch([*columns, pa.array(new, pa.int8())], ["rid", *names, "around", "new"])

    return docs.select("rid", "text").mapInArrow(of, f"rid long, {', '.join(f'{n} long' for n in names)}, around long, new byte")


def _survivors(rows: DataFrame, level: int) -> DataFrame:
    """The rows whose window of a level is repeated, with agree (whether all words around all its occurrences are equal).

    Counts are joined back by the complement, which they aren't dealt out by: both sides then have an exchange, so that
    skew can be split.
    """
    h, own = f"h{level}", F.getbit("new", F.lit(level)).cast("long")
    counts = rows.groupBy(h).agg(F.sum(own).alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).filter("n > 1")
    counts = counts.select(F.bitwise_not(h).alias("other"), (F.col("a") == F.col("b")).alias("agree"))
    return rows.drop("agree").withColumn("other", F.bitwise_not(h)).join(counts, "other").drop("other")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each item of an array column of longs; null has none."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _among(row: np.ndarray, value: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each (row, value) is among those listed."""
    key = lambda r, v: mixed(v + mixed(r.astype(np.uint64)))
    return np.isin(key(row, value), key(*listed))


def _windows(flagged: DataFrame, window: int) -> DataFrame:
    """rid, anchor and full of each final window around the anchors that a row's `mixed` lists."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                words, counts = split(step.column("text"))
                found = Groups(word_hashes(words), counts, window)
                own = np.flatnonzero(_among(found.owner, found.anchor, _lists(step.column("mixed"))))
                n = found.end[own] - found.begin[own] + 1
                places = ranges(found.begin[own], n)
                rid = step.column("rid").to_numpy(zero_copy_only=False)[np.repeat(found.owner[own], n)]
                columns = [rid, np.repeat(found.anchor[own], n).view(np.int64), found.full[places].view(np.int64)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["rid", "anchor", "full"])

    return flagged.select("doc_id", "rid", "text", "mixed").mapInArrow(of, "rid long, anchor long, full long")


def _kept(flagged: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row by its lists: whole (anchors) and repeated (final windows)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                words, counts = split(step.column("text"))
                at, stay = starts(counts), np.ones(len(words), bool)
                whole, repeated = _lists(step.column("whole")), _lists(step.column("repeated"))
                if len(whole[0]) or len(repeated[0]):
                    found = Groups(word_hashes(words), counts, window)
                    own = _among(found.owner, found.anchor, whole)
                    places = ranges(found.begin[own], (found.end - found.begin + 1)[own])
                    n = found.end - found.begin + 1
                    every, owner = ranges(found.begin, n), np.repeat(found.owner, n)
                    places = np.concatenate((places, every[_among(owner, found.full[every], repeated)]))
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + window, -1)
                    stay = np.cumsum(cover[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(stay)))[at]
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(stay)))
                removed = counts - np.diff(left)
                yield pa.record_batch(
                    [step.column("doc_id"), pa.array(counts), pa.array(removed), pa.compute.binary_join(lists, " ")],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return flagged.select("doc_id", "rid", "text", "whole", "repeated").mapInArrow(of, "doc_id long, n_words long, n_removed long, kept_text string")


def dedup(docs: DataFrame, window: int = WINDOW, survivors: list[tuple[int, int]] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row.

    survivors: a list to which (length, groups of windows that are repeated at that length) are added.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    own = docs.select(F.col("doc_id").cast("long"), text, F.xxhash64("doc_id", "text").alias("rid"))
    rows, before = _anchors(own, window), None
    for level, length in enumerate(lengths(window)):
        # Hashes as columns of a table: a checkpoint's rows take twice the disk.
        rows, path = written(_survivors(rows, level), f"repeated-{length}")
        if before:
            remove(docs.sparkSession, before)
        n, before = rows.count(), path
        if survivors is not None:
            survivors.append((length, n))
        if not n:  # nothing is repeated
            remove(docs.sparkSession, path)
            nothing = own.select("doc_id", "rid", "text", *(F.lit(None).cast("array<long>").alias(c) for c in ("whole", "repeated")))
            return _kept(nothing, window)
    anchor = f"h{len(lengths(window)) - 1}"
    listed = lambda c, v: F.collect_set(F.when(c, F.col(v)))
    flags = cut(rows.groupBy("rid").agg(listed(F.col("agree"), anchor).alias("whole"), listed(~F.col("agree"), anchor).alias("mixed")))
    remove(docs.sparkSession, before)
    # The final length: windows around the others, counted one by one.  One exchange of texts serves both joins.
    texts, by = own.withColumn("other", F.bitwise_not("rid")), F.bitwise_not("rid").alias("other")
    windows = _windows(texts.join(flags.filter("size(mixed) > 0").select(by, "mixed"), "other"), window)
    other = [F.bitwise_not(c).alias(f"other_{c}") for c in ("anchor", "full")]
    again = windows.groupBy("anchor", "full").agg(F.count("*").alias("n")).filter("n > 1").select(*other)
    repeated = windows.select("rid", "full", *other).join(again, ["other_anchor", "other_full"])
    repeated = repeated.groupBy("rid").agg(F.collect_set("full").alias("repeated"))
    whole = flags.filter("size(whole) > 0").select("rid", "whole")
    found = whole.join(repeated, "rid", "full").select(by, "whole", "repeated")
    return _kept(texts.join(found, "other", "left"), window)
