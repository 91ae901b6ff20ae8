"""SimHash near-duplicates: fingerprints joined with themselves by a binary trie.

Fingerprints are made in Arrow batches.  The self-join walks pairs of trie nodes, adds up the bits in which their paths
differ and drops a pair once the error budget is exceeded.  The upper trie is shared out by blocks of bits: fingerprints
of 64 bits within a budget of k agree in one of k + 1 blocks at least, so each is dealt once for each block, turned so
that the block leads, and meets those with the same leading block in one task.  There the walk begins at the pairs of
equal nodes under the block and goes down level by level in numpy.  So a fingerprint has k + 1 copies whatever the size
of the table.  Where a leading block has over MOST fingerprints, those are dealt once more, by blocks of their other
bits: (k + 1) ** 2 copies, of those alone.  A task returns a spanning forest of its links, never all pairs; one
task joins the forests to components, or alternating star contractions where they have more than ALONE edges.

Only distinct fingerprints enter the join, so exact copies cost nothing there however many there are.

Defined results: a null or empty text has no words and the fingerprint zero, linked like any other; repeated rows and
null doc_ids are rows of their own; the component of rows that all lack a doc_id is null; other columns don't matter.  `dedup`
keeps one row of each component: the one with the least doc_id, one without a doc_id only if no row has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm._shared import cut, small_batches, written
from lodeseam.llm._text import mixed, plain, ranges, split, starts, steps

#: A leading block with more distinct fingerprints is parted once more; fingerprints of a walk about.
MOST, WALK = 1 << 20, 1 << 17
#: Node pairs, or pairs of fingerprints, that a task expands at once, and those under a node pair that are compared outright.
FRONTIER, OUTRIGHT = 1 << 19, 4
#: Edges that one task joins to components (16 bytes each); more are joined by stars.
ALONE = 1 << 20

#: Byte value to eight one-byte counters, one a bit.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(text: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text."""
    words, counts = split(pc.ascii_lower(plain(text)))
    out = np.zeros(len(counts), np.uint64)
    if not len(words):
        return out
    at = starts(counts)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(lengths) - 1  # of each word in the joined text
    begins = ends - lengths + 1
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
    data = memoryview(joined.encode())
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = ranges(at[:-1], n)
    last = np.minimum(first + shingle, np.repeat(at[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], seed) for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)),
        np.uint64,
        len(first),
    )
    lanes = _COUNTERS[hashes.view(np.uint8).reshape(-1, 8)]
    # One-byte counters hold 255 shingles: blocks of so many, then the blocks of a document.
    full = np.flatnonzero(n)
    blocks = -(-n[full] // 255)
    block_at = np.repeat(starts(n)[full], blocks) + 255 * ranges(np.zeros(len(full), np.int64), blocks)
    sums = np.add.reduceat(lanes, block_at, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    ones = np.add.reduceat(sums, starts(blocks)[:-1], axis=0)
    bits = (2 * ones > n[full, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """id and fp, the fingerprint of the text as a signed long, of every row (id, text)."""
    small_batches(rows.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                fp = simhash(step.column("text"), shingle).view(np.int64)
                yield pa.record_batch([step.column("id"), pa.array(fp)], ["id", "fp"])

    return rows.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "id long, fp long")


def wide_simhash(hashes: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of `words` times 64 bits, a row a text, of texts that have n of the (distinct) shingles' hashes each.

    Bits are summed in planes, a plane a binary digit of all 64 counters of a word: two shingles of a text are added at
    a time, then two such sums, and so on.
    """
    out = np.zeros((len(n), words), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    for lo in range(0, words, 4):
        seeds = mixed(np.arange(lo + 1, min(lo + 4, words) + 1, dtype=np.uint64))
        planes, counts = [mixed(hashes[:, None] + seeds)], n[full].astype(np.int64)
        while counts.max() > 1:
            half, at = (counts + 1) // 2, starts(counts)
            own = np.repeat(at[:-1], half) + 2 * ranges(np.zeros(len(half), np.int64), half)
            paired = own + 1 < np.repeat(at[1:], half)
            other, paired = np.minimum(own + 1, at[-1] - 1), -paired.astype(np.uint64)[:, None]
            carry, sums = None, []
            for plane in planes:
                x, y = plane[own], plane[other] & paired
                both = x ^ y
                sums.append(both if carry is None else both ^ carry)
                carry = x & y if carry is None else (x & y) | (both & carry)
            planes, counts = [*sums, carry], half
        ones = np.zeros((len(full), 64 * len(seeds)), np.int64)
        for k, plane in enumerate(planes):
            ones += np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little").astype(np.int64) << k
        bits = (2 * ones > n[full, None]).astype(np.uint8)
        out[full, lo : lo + len(seeds)] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


class Trie:
    """The binary trie of sorted distinct 64-bit keys: for each level the nodes' first keys, and their children."""

    def __init__(self, keys: np.ndarray):
        self.keys, n = keys, len(keys)
        # Keys i and i+1 part after so many leading bits.
        x = keys[1:] ^ keys[:-1]
        for s in (1, 2, 4, 8, 16, 32):
            x = x | (x >> np.uint64(s))
        self.parts = 64 - np.bitwise_count(x).astype(np.int64)
        self.n = n

    def level(self, depth: int) -> np.ndarray:
        """First key of each node at a depth, and the end."""
        return np.concatenate(([0], np.flatnonzero(self.parts < depth) + 1, [self.n]))

    def children(self, depth: int, now: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node at a depth its child for bit 0 and for bit 1, or -1."""
        bit = (self.keys[below[:-1]] >> np.uint64(63 - depth)) & np.uint64(1)
        parent = np.searchsorted(now, below[:-1], "right") - 1
        zero, one = np.full(len(now) - 1, -1), np.full(len(now) - 1, -1)
        ids = np.arange(len(below) - 1)
        zero[parent[bit == 0]], one[parent[bit == 1]] = ids[bit == 0], ids[bit == 1]
        return zero, one


class Forest:
    """Union of links, to the smallest index."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := self.root[x], x):
            x = up
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def trie_links(keys: np.ndarray, budget: int, depth: int = 0, outright: int = OUTRIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between distinct sorted keys that differ in at most `budget` bits, none of them in the first `depth`."""
    trie, n = Trie(keys), len(keys)
    forest = Forest(n)
    levels: dict[int, tuple] = {}

    def at(depth: int) -> tuple:
        if depth not in levels:
            now = trie.level(depth)
            levels[depth] = now, trie.children(depth, now, trie.level(depth + 1)) if depth < 64 else None
        return levels[depth]

    def compare(first_x: np.ndarray, first_y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> None:
        ends = np.cumsum(sx * sy)
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FRONTIER, "right")))
            n, own = (sx * sy)[lo:hi], ranges(np.zeros(hi - lo, np.int64), (sx * sy)[lo:hi])
            i = np.repeat(first_x[lo:hi], n) + own // np.repeat(sy[lo:hi], n)
            j = np.repeat(first_y[lo:hi], n) + own % np.repeat(sy[lo:hi], n)
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i < j)
            forest.add(i[near], j[near])
            lo = hi

    def walk(depth: int, x: np.ndarray, y: np.ndarray, errors: np.ndarray) -> None:
        while len(x):
            if len(x) > FRONTIER:
                half = len(x) // 2
                walk(depth, x[:half], y[:half], errors[:half])
                x, y, errors = x[half:], y[half:], errors[half:]
                continue
            now, kids = at(depth)
            size_x, size_y = np.diff(now)[x], np.diff(now)[y]
            small = size_x * size_y <= (outright if depth < 64 else math.inf)
            if small.any():
                compare(now[x[small]], now[y[small]], size_x[small], size_y[small])
                x, y, errors = x[~small], y[~small], errors[~small]
                if not len(x):
                    return
            nexts = []
            for p in (0, 1):
                for q in (0, 1):
                    u, v, e = kids[p][x], kids[q][y], errors + (p != q)
                    keep = (u >= 0) & (v >= 0) & (e <= budget)
                    if (p, q) == (1, 0):
                        keep &= x != y  # else the mirror of (0, 1)
                    nexts.append((u[keep], v[keep], e[keep]))
            x, y, errors = (np.concatenate(z) for z in zip(*nexts, strict=True))
            depth += 1

    if n:
        own = np.arange(len(at(depth)[0]) - 1)
        walk(depth, own, own, np.zeros(len(own), np.int8))
    root = forest.find(np.arange(n))
    linked = np.flatnonzero(root != np.arange(n))
    return keys[linked], keys[root[linked]]


def _cuts(bits: int, parts: int) -> list[int]:
    """Where each of so many nearly equal blocks of bits begins, and the end."""
    return [bits * k // parts for k in range(parts + 1)]


def turned(x: np.ndarray, by: int, bits: int = 64) -> np.ndarray:
    """The last `bits` bits of each number turned left, those before them left alone."""
    if not 0 < by < bits:
        return x
    low = x if bits == 64 else x & np.uint64((1 << bits) - 1)
    out = low << np.uint64(by) | low >> np.uint64(bits - by)
    return out if bits == 64 else (out & np.uint64((1 << bits) - 1)) | (x ^ low)


def links(distinct: DataFrame, budget: int = 3, most: int = MOST) -> DataFrame:
    """Edges (a, b), spanning forests of what links the distinct fingerprints `fp` in each task."""
    cuts = _cuts(64, budget + 1)
    wide = [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    # Blocks with very many fingerprints: at most all values of all blocks are counted.
    lead = lambda k: F.shiftrightunsigned(F.shiftleft("fp", cuts[k]), 64 - wide[k])
    blocks = distinct.select(F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), lead(k).alias("block")) for k in range(budget + 1)))).alias("t"))
    full = blocks.groupBy("t.turn", "t.block").count().filter(F.col("count") > most).collect()
    full = {k: np.array([r["block"] for r in full if r["turn"] == k], np.uint64) for k in range(budget + 1)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(budget + 1):
                keys, left = turned(fp, cuts[k]), 64 - wide[k]
                often = np.isin(keys >> np.uint64(left), full[k])
                more = _cuts(left, budget + 1)
                sets = [(0, wide[k], keys[~often])]
                sets += [(j + 1, wide[k] + more[j + 1] - more[j], turned(keys[often], more[j], left)) for j in range(budget + 1)]
                for sub, depth, own in sets:
                    if len(own):
                        group = (own >> np.uint64(64 - depth)).view(np.int64)
                        kind = pa.array(np.full(len(own), k * (budget + 2) + sub, np.int32))
                        yield pa.record_batch([kind, pa.array(group), pa.array(own.view(np.int64))], ["kind", "block", "key"])

    def back(keys: np.ndarray, kind: int) -> np.ndarray:
        k, sub = divmod(kind, budget + 2)
        left = 64 - wide[k]
        if sub:
            keys = turned(keys, left - _cuts(left, budget + 1)[sub - 1], left)
        return turned(keys, 64 - cuts[k])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (kind, block); whole blocks are walked together."""

        def walked(kind: int, keys: np.ndarray) -> pa.RecordBatch:
            k, sub = divmod(kind, budget + 2)
            more = _cuts(64 - wide[k], budget + 1)
            x, y = trie_links(np.sort(keys), budget, wide[k] + (more[sub] - more[sub - 1] if sub else 0))
            return pa.record_batch([pa.array(back(z, kind).view(np.int64)) for z in (x, y)], ["a", "b"])

        kind, held, size = None, [], 0
        for batch in batches:
            kinds, blocks, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "block", "key"))
            cut_at = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(blocks) != 0)) + 1
            for lo, hi in zip([0, *cut_at.tolist()], [*cut_at.tolist(), len(keys)], strict=True):
                if held and (kinds[lo] != kind or (size >= WALK and blocks[lo] != block)):
                    yield walked(kind, np.concatenate(held))
                    held, size = [], 0
                kind, block = int(kinds[lo]), blocks[lo]
                held.append(keys[lo:hi].view(np.uint64))
                size += hi - lo
        if held:
            yield walked(kind, np.concatenate(held))

    dealt = distinct.select("fp").mapInArrow(deal, "kind int, block long, key long")
    dealt = dealt.repartition("kind", "block").sortWithinPartitions("kind", "block")
    return dealt.mapInArrow(join, "a long, b long")


def _rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b), and the smallest node that it reaches.

    A root goes to its smallest neighbour, and paths are halved until they have one step: two turns leave at most half
    of the roots that still have an edge.
    """
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node of a task's edges (a, b)."""
    held = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
    if held:
        nodes, roots = _rooted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for lo in range(0, len(nodes), FRONTIER):
            yield pa.record_batch([pa.array(x[lo : lo + FRONTIER]) for x in (nodes, roots)], ["node", "root"])


def components(edges: DataFrame, most: int | None = None, rows: int | None = None, alone: int = ALONE) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root the smallest node reachable.

    Up to `alone` edges are joined in one task: turns of stars have eight shuffles each, and with many partitions their
    tasks and plans are what fills the driver.  More edges are joined by large-star and small-star by turns.  With
    `most` at most so many of these are taken: nodes of one root are linked then, but not all that are have one root.
    rows: how many edges there are at most, where that is known.

    Each star is a minimum that is combined before the shuffle and a join back by the complement, which the minima
    aren't dealt by: both sides then have an exchange, so that a hub with very many edges is split like any skewed key.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # Large: each node's neighbours above it go to its smallest neighbour; small: those below it and itself.
        both = (
            e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
            if large
            else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        other = F.bitwise_not("u").alias("other")
        near = both.select("v", other).join(least.select("u", "m", other).hint("merge"), "other")
        if large:
            return near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        return near.filter("v <> m").select("v", "m").union(least.select("u", "m")).toDF("a", "b").distinct()

    # Joins by sorting alone: broadcasts of every turn would add up on the driver.
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), rows)
    found = edges.count() if rows is None or rows > alone else rows
    if found <= alone:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    edges = cut(edges.distinct(), found)
    before, turns = sign(edges), 0
    while before[0] and turns != most:
        edges, turns = cut(star(star(edges, True), False), before[0]), turns + 1
        if turns == most or (now := sign(edges)) == before:
            break
        before = now
    if most is not None:  # a node may still have several edges
        edges = edges.groupBy("a").agg(F.min("b").alias("b"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct().join(edges.select("a").hint("merge"), F.col("b") == F.col("a"), "left_anti"))


def _grouped(fps: DataFrame, budget: int) -> DataFrame:
    """fps (id, fp, first) with `least`, the smallest `first` of the component of each row's fingerprint."""
    distinct = cut(fps.groupBy("fp").agg(F.min("first").alias("own")))
    roots = components(links(distinct, budget)).withColumnRenamed("node", "fp")
    linked = roots.join(distinct, "fp").select("root", "fp", "own")
    least = linked.groupBy("root").agg(F.min("own").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    whole = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "own").alias("least"))
    # Joined back by the complement, so that the rows of one fingerprint can be split (see `components`).
    other = F.bitwise_not("fp").alias("other")
    return fps.select("id", "fp", other).join(whole.select("least", other), "other").select("id", "fp", "least")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable over links."""
    fps = cut(fingerprints(docs.select(F.col("doc_id").alias("id"), "text"), shingle))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    found = _grouped(fps.withColumn("first", F.col("id")), budget)
    return found.select(F.col("id").alias("doc_id"), digits, F.col("least").alias("component_id"))


def dedup(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row of each component, with docs' columns."""
    # Numbered as it is written: rows keep their numbers however often they are read.
    rows, _ = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "simhash")
    fps = cut(fingerprints(rows.select("id", F.col("row.text").alias("text")), shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id").alias("first")
    ids = rows.select("id", F.col("row.doc_id").cast("long").alias("doc_id"))
    found = _grouped(fps.join(ids, "id").select("id", "fp", order), budget)
    return rows.join(found.filter("id = least.id").select("id"), "id", "left_semi").select("row.*")
