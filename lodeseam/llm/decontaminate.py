"""Benchmark decontamination with an FM-index for each training shard.

A shard is about SHARD_BYTES of documents.  Its sequence holds, document after document, the runs of words that
benchmark items use and that are long enough for a test window; every other word could only break a match, so each run
ends in a sentinel instead.  The index over that sequence is a suffix array's Burrows-Wheeler transform in a wavelet
tree with block counts, and every SAMPLE_EVERY-th suffix position.  Test windows are searched backward all at once, as
a trie of their reversed words: what windows have in common at their ends is searched once, a step being two rank
queries down the wavelet tree for all nodes of a level, and what is under an empty interval isn't searched (nor is what
ends in two words that the shard never has one after the other).  So a shard costs little more than its own length and
the benchmark's distinct pairs of words, not its windows times their lengths.  Occurrences are located by LF-steps to a
sampled position.  The spans they cover are merged for each document.

Test windows go to the workers in blocks of at most BLOCK_BYTES of text, whatever the size of the benchmark, and all of
them are searched in one pass over the documents.

Defined results: a null or empty text or item has no words, is never hit and hits nothing; an item of fewer words than
a window is one window; a null item_id hits but isn't listed; repeated rows are rows of their own; an empty benchmark
hits nothing; other columns pass
through `clean`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodeseam.llm._shared import ARROW_ROWS, small_batches
from lodeseam.llm._text import alnum, mixed, ranges, split, starts, steps

WINDOW = 13
#: Text bytes of a shard, of a block of benchmark items, and rows between two sampled suffixes.
SHARD_BYTES, BLOCK_BYTES, SAMPLE_EVERY = 12_000_000, 4_000_000, 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    key = s[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first row of the group
    width = 1
    while True:
        group_end = np.concatenate((new[1:], [True])) if n else new
        tied = np.flatnonzero(~(new & group_end))
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        sub = np.lexsort((after, rank[at]))
        order[tied] = at = at[sub]
        after, own = after[sub], rank[at]
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])))
        new[tied] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: for each bit of a symbol, from the highest, the stably parted bits."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = s.astype(np.int64)
        for d in reversed(range(self.depth)):
            bit = (s >> d) & 1
            packed = np.zeros((len(s) // 64 + 1) * 8, np.uint8)
            own = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(own)] = own
            words = packed.view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, bits = i >> 6, (i & 63).astype(np.uint64)
        inside = self.words[k][word] & ((np.uint64(1) << bits) - np.uint64(1))
        return self.before[k][word] + np.bitwise_count(inside)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(i), i
        for k in range(self.depth):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol, lo, at = np.zeros_like(i), np.zeros_like(i), i
        for k in range(self.depth):
            word, bits = at >> 6, (at & 63).astype(np.uint64)
            one = ((self.words[k][word] >> bits) & np.uint64(1)).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, at)
            lo, at = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, at - b)
            symbol = symbol << 1 | one
        return symbol, at - lo


class FMIndex:
    """Backward search and location over a sequence of symbols 0 (sentinels) to symbols - 1."""

    def __init__(self, s: np.ndarray, symbols: int):
        # Sentinels differ, so that no suffix compares beyond its run: the k-th is smaller than the next.
        n_sentinels = int((s == 0).sum())
        unique = s.astype(np.int64) + n_sentinels
        unique[s == 0] = np.arange(n_sentinels)
        order = suffix_array(unique)
        self.n = len(s)
        self.bwt = WaveletTree(s[order - 1], symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        self.sampled = np.where(order % SAMPLE_EVERY == 0, order, -1)
        # The row before a sentinel's start can't be found by an LF-step (sentinels rank by place): sampled as well.
        begins = np.concatenate(([True], s[:-1] == 0))[order] if self.n else np.zeros(0, bool)
        self.sampled[begins] = order[begins]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a symbol before what has the rows [lo, hi)."""
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each row."""
        out, steps_done, at = np.full(len(rows), -1), np.zeros(len(rows), np.int64), rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            known = self.sampled[at[todo]]
            done = known >= 0
            out[todo[done]] = known[done] + steps_done[todo[done]]
            todo = todo[~done]
            symbol, before = self.bwt.access(at[todo])
            at[todo] = self.first[symbol] + before
            steps_done[todo] += 1
        return out


def _pairs_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of pairs of words in a table of 2^22."""
    return (mixed(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) >> np.uint64(42)).astype(np.int64)


class Reversed:
    """Distinct windows of one length as a trie of their reversed words, down to where all windows are apart."""

    def __init__(self, rows: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, *rows.T))  # by the last word, then the one before it
        rows, items = rows[order], items[order]
        apart, levels = rows[1:] != rows[:-1], []
        self.first = np.flatnonzero(np.concatenate(([True], apart.any(axis=1), [True])))
        #: Of each window the items that have it: owners[first[w] : first[w + 1]].
        self.owners, self.rows = items, rows[self.first[:-1]]
        self.length, new = rows.shape[1], np.zeros(len(self.rows) - 1, bool)
        apart, at, parent = self.rows[1:] != self.rows[:-1], None, None
        for k in range(self.length - 1, -1, -1):
            new = new | apart[:, k]
            every = np.concatenate(([True], new))
            at = np.flatnonzero(every)
            levels.append((self.rows[at, k], None if parent is None else parent[at]))
            parent = (np.cumsum(every) - 1).astype(np.int32)
            if len(at) == len(self.rows):
                break
        self.levels = levels
        if len(levels) > 1:
            self.pairs = _pairs_of(levels[1][0], levels[0][0][levels[1][1]])
        elif self.length > 1:
            self.pairs = _pairs_of(self.rows[:, -2], self.rows[:, -1])

    def search(self, index: FMIndex, has_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur, and their rows [lo, hi)."""
        symbol, _ = self.levels[0]
        lo, hi = index.first[symbol], index.first[symbol + 1]
        own = np.arange(len(symbol))
        for k in range(1, self.length):
            alive = hi > lo
            if k < len(self.levels):
                symbol, parent = self.levels[k]
                place = np.full(len(self.levels[k - 1][0]), -1)
                place[own[alive]] = np.flatnonzero(alive)
                found = place[parent]
                some = found >= 0
                if k == 1:
                    some &= has_pair[self.pairs]
                own = np.flatnonzero(some)
                lo, hi, symbol = lo[found[own]], hi[found[own]], symbol[own]
            else:  # a node is a window
                if k == 1:
                    alive &= has_pair[self.pairs[own]]
                own, lo, hi = own[alive], lo[alive], hi[alive]
                symbol = self.rows[own, self.length - 1 - k]
            if not len(own):
                return own, lo, hi
            lo, hi = index.extend(symbol.astype(np.int64), lo, hi)
        alive = hi > lo
        return own[alive], lo[alive], hi[alive]


class Windows:
    """A block of benchmark items: the words they use, and their windows by length."""

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW):
        words, n = split(alnum(texts))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        at, found = starts(n), {}
        for k in np.flatnonzero(n):
            own, length = codes[at[k] : at[k + 1]], min(window, int(n[k]))
            view = np.lib.stride_tricks.sliding_window_view(own, length)
            found.setdefault(length, []).append((view, np.full(len(view), k, np.int32)))
        self.ids = ids
        # Windows that several items share are searched once.
        self.by_length = {length: Reversed(*(np.concatenate(p) for p in zip(*parts, strict=True))) for length, parts in found.items()}
        self.shortest = min(self.by_length, default=0)

    def hits(self, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, set[int]]]:
        """Of each text: its number, its number of words, a row of [begin, end) for each merged span, its items."""
        words, n = split(alnum(text))
        at = starts(n)
        if not self.by_length or not len(words):
            yield from ((k, int(n[k]), np.zeros((0, 2), np.int64), set()) for k in range(len(n)))
            return
        codes = pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # Runs of known words inside a document.
        edge = np.ones(len(codes) + 1, bool)
        edge[1:-1] = (codes[1:] > 0) != (codes[:-1] > 0)
        edge[at] = True
        cuts = np.flatnonzero(edge)
        begin, length = cuts[:-1], np.diff(cuts)
        long = (codes[begin] > 0) & (length >= self.shortest)
        begin, length = begin[long], length[long]
        places = ranges(begin, length)
        ends = np.cumsum(length + 1) - 1
        s, origin = np.zeros(int((length + 1).sum()), np.int64), np.full(int((length + 1).sum()), -1)
        inner = np.ones(len(s), bool)
        inner[ends] = False
        s[inner], origin[inner] = codes[places], places
        cover, items = np.zeros(len(codes) + 1, np.int64), {}
        if len(s):
            index, has_pair = FMIndex(s, len(self.vocabulary) + 1), np.zeros(1 << 22, bool)
            has_pair[_pairs_of(s[:-1], s[1:])] = True
            for size, trie in self.by_length.items():
                windows, lo, hi = trie.search(index, has_pair)
                found = origin[index.locate(ranges(lo, hi - lo))]
                np.add.at(cover, found, 1)
                np.add.at(cover, found + size, -1)
                docs = np.searchsorted(at, found, "right") - 1
                which = np.repeat(windows, hi - lo)
                for doc, w in np.unique(np.stack((docs, which), 1), axis=0).tolist():
                    items.setdefault(doc, set()).update(trie.owners[trie.first[w] : trie.first[w + 1]].tolist())
        covered = np.cumsum(cover[:-1]) > 0
        for k in range(len(n)):
            if k not in items:
                yield k, int(n[k]), np.zeros((0, 2), np.int64), set()
                continue
            own = np.diff(np.concatenate(([0], covered[at[k] : at[k + 1]].astype(np.int8), [0])))
            yield k, int(n[k]), np.stack((np.flatnonzero(own == 1), np.flatnonzero(own == -1)), 1), items[k]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Items of the benchmark in blocks of bounded size, one at a time on the driver."""
    ids, texts, size = [], [], 0
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    for r in rows.toLocalIterator():
        ids.append(None if r["item_id"] is None else str(r["item_id"]))
        texts.append(r["text"])
        size += len(r["text"].encode())
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


_SPANS = "array<struct<begin: long, end: long>>"


def _shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.StructArray, pa.Array]]:
    """The rows of batches and their texts, about SHARD_BYTES at a time."""
    held, size = [], 0
    for batch in batches:
        rows = batch.column(0)
        whole = pa.record_batch([rows, rows.field(text_at)], ["row", "text"])
        for step in steps(whole, "text", SHARD_BYTES):
            more = pc.sum(pc.binary_length(step.column(1))).as_py() or 0
            if held and size + more > SHARD_BYTES:
                yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))
                held, size = [], 0
            held.append(step)
            size += more
    if held:
        yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (all columns of docs), n_words, spans (begin and end word of each span under a window, by block) and items."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark)]
    rows = docs.select(F.struct("*").alias("row"))
    names = [c.lower() for c in docs.columns]
    text_at = names.index("text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Windows(b.value[0], pa.array(b.value[1], pa.string()), window) for b in blocks]
        for row, text in _shards(batches, text_at):
            n_words, spans, items = [0] * len(row), [[] for _ in row], [[] for _ in row]
            for block in own:
                for k, n, found, which in block.hits(text):
                    n_words[k] = n
                    spans[k] += [{"begin": a, "end": b} for a, b in found.tolist()]
                    items[k] += [block.ids[i] for i in which if block.ids[i] is not None]
            kinds = pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
            added = [pa.array(x, t) for x, t in zip((n_words, spans, items), kinds, strict=True)]
            for lo in range(0, len(row), ARROW_ROWS):
                yield pa.record_batch([c.slice(lo, ARROW_ROWS) for c in (row, *added)], ["row", "n_words", "spans", "items"])

    added = spark.sql(f"SELECT 0L AS n_words, CAST(array() AS {_SPANS}) AS spans, CAST(array() AS array<string>) AS items").schema
    return rows.mapInArrow(search, StructType([StructField("row", rows.schema["row"].dataType), *added]))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["begin"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged(s) for s in batch.column("spans").to_pylist()]
            items = [sorted(set(i)) for i in batch.column("items").to_pylist()]
            n = batch.column("n_words").to_pylist()
            hit = [sum(b - a for a, b in s) for s in spans]
            yield pa.record_batch(
                [
                    batch.column("row").field(0),
                    batch.column("n_words"),
                    pa.array(hit, pa.int64()),
                    pa.array(map(len, items), pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                    pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, n, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = scan(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, window)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return found.select(F.struct("row.doc_id").alias("row"), "n_words", "spans", "items").mapInArrow(count, schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span of words cut out, from its first word's start to the start of the word after it."""
    data = text.encode()
    blank = np.frombuffer(b" " + alnum(pa.array([text]))[0].as_py().encode() + b" ", np.uint8) == 32
    begins = np.flatnonzero(blank[:-1] & ~blank[1:])
    begins = np.append(begins, len(data))
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begins[a]])
        at = int(begins[b])
    return b"".join([*out, data[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows; spans of benchmark words in the others are cut out, and n_chars, if there, follows."""
    found = scan(docs, benchmark, window)
    names = [c.lower() for c in docs.columns]
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged(s) for s in batch.column("spans").to_pylist()]
            n = batch.column("n_words").to_pylist()
            hit = [sum(b - a for a, b in s) for s in spans]
            stay = [not (h > 0 and 20 * h >= w) for h, w in zip(hit, n, strict=True)]
            columns = batch.column("row").flatten()
            if any(h and s for h, s in zip(hit, stay, strict=True)):
                texts = columns[text_at].to_pylist()
                for k, s in enumerate(spans):
                    if s and stay[k]:
                        texts[k] = _without(texts[k], s)
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars_at is not None:
                    counts = columns[chars_at].to_pylist()
                    counts = [len(t) if s else c for t, s, c in zip(texts, spans, counts, strict=True)]
                    columns[chars_at] = pa.array(counts, columns[chars_at].type)
            rows = pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema.field("row").type)))
            yield rows.filter(pa.array(stay, pa.bool_()))

    return found.mapInArrow(apply, docs.schema)
