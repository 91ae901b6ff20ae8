"""Near copies by the similarity of texts themselves: Jaccard of five-word shingles, THRESHOLD or more.

The method is SimHash with a trie, as in `simhash_dedup`, wide enough for that similarity, and an exact check.  A text
has PRINTS fingerprints of 64 bits, made of its distinct shingles; each is dealt once for each of its four blocks of 16
bits, turned so that the block leads.  Under a leading block the trie links what differs in at most BUDGET bits; what it
links is a band.  Candidates are pairs of a band, links come from the exact similarity of their shingles, and components
of links lose all rows but one.  By the angle of two sets' indicator vectors, two texts at the threshold differ in a bit
with a chance of 0.151, so they share a band of one block with 0.070 and miss all 136 with 5 in 100,000; at 0.85 they
miss with 2 in ten million.  Two unrelated texts share a band with a chance of 7 in ten million.

Texts with the same words in the same order are one node, so exact copies cost nothing in the join.  A first round deals
FIRST of the fingerprints and compares a band's nodes only with a hub; nodes that are known to be linked are not compared
again.  Bands of more than CROWDED nodes that share nodes are a crowd, which is one band from there on: a text among very many
similar ones lies in bands of nearly all blocks, and is a row of one.  At the end all pairs of a band that still lie in different components are compared inside tasks, block by block of BLOCK
nodes, so that a band of any size is many small tasks: first by all fingerprints (a pair at the threshold differs in DIFFER
or fewer bits but for a chance of 3 in ten million), which leave the nodes that may have a partner in the block,
then by those nodes' texts.  A task returns a spanning forest of its links, never all pairs.

Defined results: words are lower-cased (ASCII) and parted by ASCII white space; a text of fewer words than a shingle is
one shingle; null and empty texts have none and are copies of each other.  Of a component the row with the least doc_id
stays, one without a doc_id only if no row has one; of rows with equal ids one stays.  Rows of unlinked texts all stay,
whatever their doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm._shared import cut, small_batches, written
from lodeseam.llm._text import mixed, plain, ranges, split, starts, steps, window_hashes, word_hashes
from lodeseam.llm.simhash_dedup import Forest, components, trie_links, turned, wide_simhash

SHINGLE, THRESHOLD = 5, 0.8
#: Fingerprints of 64 bits a text, those of the rounds with hubs, and bits in which two may differ under one leading block.
PRINTS, FIRST, BUDGET = 34, 4, 12
#: Rounds of comparing with hubs before what is left is compared pair by pair, and turns of joining links after each where these are too many for one task.
ROUNDS, TURNS = 1, 2
#: Bits in which all fingerprints of two may differ at most, and nodes of a band that are compared with as many others in a task.
DIFFER, BLOCK = 416, 512
#: Fingerprints of a trie about, and pairs of them that are compared outright.
WALK, OUTRIGHT = 1 << 17, 4096
#: A band of more nodes is one of a crowd: chance alone doesn't make any.
CROWDED = 16
#: Pairs whose texts are compared in one cell about, and row numbers that are broadcast at most (8 bytes each).
CELL, MOST_BROADCAST = 1024, 500_000


def shingles(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all texts' shingles, how many each text has, and 128 bits that texts of the same words share."""
    words, counts = split(pc.ascii_lower(plain(text)))
    at, hashes = starts(counts), word_hashes(words)
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    to, out = starts(n), np.zeros(int(n.sum()), np.uint64)
    for length in range(1, shingle + 1):
        own = np.flatnonzero(counts >= shingle if length == shingle else counts == length)
        if len(own):
            out[ranges(to[own], n[own])] = window_hashes(hashes, length)[ranges(at[own], n[own])]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), " ")
    return out, n, [xxhash.xxh3_128_digest(t) for t in joined.to_pylist()]


def distinct(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes without repeats, and how many it has."""
    owner = np.repeat(np.arange(len(n)), n)
    own = np.sort(np.unique(mixed(hashes + mixed(owner)), return_index=True)[1])
    return hashes[own], np.bincount(owner[own], minlength=len(n))


def _binary(rows: np.ndarray, has: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values, empty where has is false."""
    return pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(starts(rows.shape[1] * has).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def signatures(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rid, doc_id, key and print (its fingerprints; empty for a text without words) of every row."""
    small_batches(rows.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                hashes, n, keys = shingles(step.column("text"), shingle)
                found = wide_simhash(*distinct(hashes, n), PRINTS)[n > 0].view(np.uint8)
                yield pa.record_batch([step.column("rid"), step.column("doc_id"), pa.array(keys, pa.binary()), _binary(found, n > 0)], ["rid", "doc_id", "key", "print"])

    columns = F.col("rid"), F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")
    return rows.select(*columns).mapInArrow(of, "rid long, doc_id long, key binary, print binary")


def clusters(prints: DataFrame, n: int, tables: int) -> DataFrame:
    """(band, node, component) of what the tries of `tables` fingerprints link, for each block that leads.

    prints: n rows (node, component, crowd, print); component null: the node is one; crowd null: it is in none.  Each
    fingerprint is dealt as in `simhash_dedup.links`, once a block, turned so that the block leads.  The fingerprints
    that a trie links to each other, within BUDGET bits under equal leading blocks, are a band; bands of one component
    alone, or of one crowd, are left out.
    """
    parts, names = max(8, -(-n // WALK)), ["group", "key", "node", "component", "crowd"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, component, crowd = (batch.column(c) for c in names[2:])
            found = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(len(node), -1)
            for t in range(tables):
                for k in range(4):
                    keys = turned(found[:, t], 16 * k)
                    group = (4 * t + k) * parts + ((keys >> np.uint64(48)) % np.uint64(parts)).astype(np.int64)
                    yield pa.record_batch([pa.array(group), pa.array(keys.view(np.int64)), node, component, crowd], names)

    def walked(rows: pa.Table) -> pa.RecordBatch:
        node = rows.column("node").to_numpy()
        component = pc.coalesce(rows.column("component"), rows.column("node")).to_numpy()
        crowd = pc.coalesce(rows.column("crowd"), pc.bit_wise_not(rows.column("node"))).to_numpy()
        keys, at = np.unique(rows.column("key").to_numpy().view(np.uint64), return_inverse=True)
        a, b = trie_links(keys, BUDGET, 16, OUTRIGHT)
        root = np.arange(len(keys))
        root[np.searchsorted(keys, a)] = np.searchsorted(keys, b)
        root = root[at]
        several = np.ones(len(keys), bool)
        for of in (component, crowd):
            lo, hi = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
            np.minimum.at(lo, root, of)
            np.maximum.at(hi, root, of)
            several &= lo < hi
        own = np.flatnonzero(several[root])
        band = mixed(keys[root[own]] + mixed(rows.column("group").to_numpy()[own])).view(np.int64)
        return pa.record_batch([pa.array(c) for c in (band, node[own], component[own])], ["band", "node", "component"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = np.flatnonzero(np.diff(group)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if held and held[-1].column("group")[0].as_py() != group[lo]:
                    yield walked(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield walked(pa.Table.from_batches(held))

    dealt = prints.select("node", "component", "crowd", "print").mapInArrow(deal, ", ".join(f"{c} long" for c in names))
    dealt = dealt.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(join, "band long, node long, component long")


def _checked(shingle: int, threshold: float):
    """Of rows sorted by (cell, b), a text (b null) of node a or a pair: the pairs that are similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, held = None, {}, []

        def near() -> pa.RecordBatch:
            both = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
            held.clear()
            both, good = both[np.argsort(both[:, 0], kind="stable")], np.zeros(len(both), bool)
            cuts = np.flatnonzero(np.diff(both[:, 0], prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own, others = sets[int(both[lo, 0])], [sets[x] for x in both[lo:hi, 1].tolist()]
                n = np.fromiter(map(len, others), np.int64, hi - lo)
                every = np.concatenate(others)
                found = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                shared = np.add.reduceat(found, starts(n)[:-1], dtype=np.int64)
                good[lo:hi] = shared >= threshold * (len(own) + n - shared) - 1e-9
            return pa.record_batch([pa.array(c) for c in both[good].T], ["a", "b"])

        for batch in batches:
            numbers = batch.column("cell").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if numbers[lo] != cell:
                    yield near()
                    cell, sets = numbers[lo], {}
                rows = batch.slice(lo, hi - lo)
                for step in steps(rows.filter(pc.is_null(rows.column("b"))), "text"):
                    hashes, n, _ = shingles(step.column("text"), shingle)
                    sets |= zip(step.column("a").to_pylist(), map(np.unique, np.split(hashes, np.cumsum(n)[:-1])), strict=True)
                some = rows.filter(pc.is_valid(rows.column("b")))
                held.append(np.stack([some.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1))
        yield near()

    return of


def _texts(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """rid and text of the rows whose number is among n ids (rid); few numbers go to the rows, many meet them by a shuffle."""
    ids = cut(ids.distinct(), n)
    few = ids.count() <= MOST_BROADCAST
    text = rows.select("rid", F.col("row.text").cast("string").alias("text"))
    return text.join(F.broadcast(ids) if few else ids, "rid", "left_semi")


def similar(pairs: DataFrame, n: int, rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of n pairs (a, b) of rows whose shingles have a Jaccard similarity of the threshold or more.

    Pairs lie in a square of cells of about CELL pairs by the hashes of a and b; a text goes once to each cell that
    needs it, so that a group with very many pairs doesn't move its texts once a pair.
    """
    small_batches(rows.sparkSession)
    side = int(np.ceil(np.sqrt(max(1, n) / CELL)))
    placed = pairs.withColumn("cell", side * F.pmod(F.xxhash64("a"), F.lit(side)) + F.pmod(F.xxhash64("b"), F.lit(side)))
    needed = placed.select("cell", F.col("a").alias("rid")).union(placed.select("cell", "b")).distinct()
    texts = needed.join(_texts(rows, needed.select("rid"), 2 * n), "rid")
    both = texts.select("cell", F.col("rid").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    both = both.unionByName(placed.select("cell", "a", "b", F.lit(None).cast("string").alias("text")))
    both = both.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())
    return both.mapInArrow(_checked(shingle, threshold), "a long, b long")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _with_hub(placed: DataFrame, k: int) -> DataFrame:
    """Of each band that more than one component has: its hub with every node of another component."""
    order = F.struct(F.xxhash64("node", F.lit(k)), "node", "component")
    hubs = placed.groupBy("band").agg(F.min(order).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    far = placed.join(hubs, "band").filter("component <> hub.component")
    return far.select(*_pair(F.col("node"), F.col("hub.node"))).distinct()


def _grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by (band, i, j) as tables of whole groups, `rows` of them or more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held)
        key = [whole.column(c).to_numpy() for c in ("band", "i", "j")]
        # The last group may go on in what follows.
        end = max((int(n[-1]) + 1 for c in key if len(n := np.flatnonzero(c != c[-1]))), default=0)
        if end:
            yield whole.slice(0, end)
            held = whole.slice(end).combine_chunks().to_batches()
    if held and (whole := pa.Table.from_batches(held)).num_rows:
        yield whole


def _starts(rows: pa.Table) -> np.ndarray:
    """Where each group of rows begins, and the end."""
    new = np.ones(len(rows) + 1, bool)
    new[1:-1] = np.logical_or.reduce([np.diff(rows.column(c).to_numpy()) != 0 for c in ("band", "i", "j")])
    return np.flatnonzero(new)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the nodes whose fingerprints differ little enough from those of one of another component.

    Row r is compared with row r + k of its group, for each k; where i and j differ, only nodes of different blocks are.
    """
    names = ["band", "i", "j", "block", "node", "component"]
    for rows in _grouped(batches, 8 * BLOCK):
        i, j, block, component = (rows.column(c).to_numpy() for c in ("i", "j", "block", "component"))
        prints = np.frombuffer(b"".join(rows.column("print").to_pylist()), np.uint64).reshape(len(rows), -1)
        cuts = _starts(rows)
        left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(rows)) - 1  # rows behind, in the group
        at, k, near = np.flatnonzero(left > 0), 1, np.zeros(len(rows), bool)
        while len(at):
            own = at[(component[at] != component[at + k]) & ((i[at] == j[at]) | (block[at] != block[at + k]))]
            own = own[np.bitwise_count(prints[own] ^ prints[own + k]).sum(axis=1, dtype=np.int64) <= DIFFER]
            near[own] = near[own + k] = True
            k += 1
            at = at[left[at] >= k]
        yield from rows.select(names).filter(pa.array(near)).combine_chunks().to_batches()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the sets share."""
    items, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(items, kind="stable")
    items, of = items[order], of[order]
    new = np.concatenate(([True], items[1:] != items[:-1]))
    often = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1  # what one set has alone counts for nothing
    column, of = np.cumsum(new[often]) - 1, of[often]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[of[a:b], column[a:b] - lo] = 1
        out += has @ has.T
    return out


def _linked(shingle: int, threshold: float):
    """Of each group a spanning forest of the links between nodes of different components, by their texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 2 * BLOCK):
            sets = []
            for batch in rows.select(["text"]).combine_chunks().to_batches():
                for step in steps(batch, "text"):
                    hashes, n, _ = shingles(step.column("text"), shingle)
                    sets += map(np.unique, np.split(hashes, np.cumsum(n)[:-1]))
            node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
            cuts = _starts(rows).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                shared, n = _shared(sets[lo:hi]), np.array([len(x) for x in sets[lo:hi]])
                near = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-6
                x, y = np.nonzero(np.triu(near & (component[lo:hi, None] != component[None, lo:hi]), 1))
                forest = Forest(hi - lo)
                forest.add(x, y)
                root = forest.find(np.arange(hi - lo))
                own = np.flatnonzero(root != np.arange(hi - lo))
                both = node[lo:hi][own], node[lo:hi][root[own]]
                yield pa.record_batch([pa.array(np.maximum(*both)), pa.array(np.minimum(*both))], ["a", "b"])

    return of


def _all_links(placed: DataFrame, n: int, prints: DataFrame, rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Of each band, of n nodes in all: links (a, b) that join all nodes of different components that are similar enough."""
    blocks = F.ceil(F.col("nodes") / BLOCK).cast("int")
    mixed_bands = placed.groupBy("band").agg(F.count("*").alias("nodes"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    some = placed.join(mixed_bands.select("band", blocks.alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = some.join(prints, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "print")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    maybe = cut(dealt.mapInArrow(_alike, "band long, i int, j int, block int, node long, component long"), n, dealt=True)
    texts = maybe.join(_texts(rows, maybe.select(F.col("node").alias("rid")), maybe.count()).withColumnRenamed("rid", "node"), "node")
    texts = texts.select("band", "i", "j", "node", "component", "text").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return texts.mapInArrow(_linked(shingle, threshold), "a long, b long")


def dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of near copies."""
    # Numbered as it is written: rows keep their numbers however often they are read.
    rows, _ = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")), "near-copies")
    found = cut(signatures(rows, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    nodes = cut(found.groupBy("key").agg(F.min(order).alias("least")).select(F.col("least.rid").alias("node"), "least"), found.count())
    prints = found.filter("length(print) > 0").join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "print")
    n, edges, roots = nodes.count(), None, docs.sparkSession.createDataFrame([], "node long, component long")
    crowds = docs.sparkSession.createDataFrame([], "node long, crowd long")
    for k in range(ROUNDS + 1):
        dealt = prints.join(roots, "node", "left").join(crowds, "node", "left")
        placed = cut(clusters(dealt, n, FIRST if k < ROUNDS else PRINTS), n, dealt=True)
        if k < ROUNDS:
            some = placed.count()
            pairs = cut(_with_hub(placed, k), some)
            near = similar(pairs, pairs.count(), rows, shingle, threshold)
            large = placed.groupBy("band").agg(F.count("*").alias("nodes"), F.min("node").alias("b")).filter(F.col("nodes") > CROWDED)
            together = placed.join(large, "band").select(F.col("node").alias("a"), "b")
            crowds = cut(components(together, rows=some), some).withColumnRenamed("root", "crowd")
        else:
            crowded = crowds.join(roots, "node", "left").select(F.xxhash64("crowd").alias("band"), "node", F.coalesce("component", "node").alias("component"))
            near = _all_links(placed.union(crowded), n, prints, rows, shingle, threshold)
        near = cut(near, n, dealt=True)
        edges = near if edges is None else edges.union(near)
        links = edges.count()
        roots = cut(components(edges, TURNS if k < ROUNDS else None, links), links).withColumnRenamed("root", "component")
    whole = nodes.join(roots, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least")["rid"].alias("rid"))
    return rows.join(whole.select("rid"), "rid", "left_semi").select("row.*")
