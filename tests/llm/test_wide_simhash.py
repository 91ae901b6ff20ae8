"""The pipeline's near-duplicate candidates: wide SimHash fingerprints, joined by tries."""

import random

import numpy as np
import pytest
from test_near_copies import near, words

from lodeseam.llm import near_copies
from lodeseam.llm._text import mixed
from lodeseam.llm.simhash_dedup import trie_links, wide_simhash


def test_bits_are_set_in_over_half_of_the_hashes():
    r = np.random.default_rng(3)
    n = np.array([0, 1, 2, 3, 8, 255, 256, 0, 301])
    hashes, at = r.integers(0, 2**63, n.sum()).astype(np.uint64), 0
    found = wide_simhash(hashes, n, 6)
    for row, size in zip(found, n.tolist(), strict=True):
        for t in range(6):
            own = [int(x) for x in mixed(hashes[at : at + size] + mixed(np.array([t + 1], np.uint64)))]
            assert int(row[t]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > size)
        at += size


@pytest.mark.parametrize("outright", [4, 4096])
def test_wide_budget(outright):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 30).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(48, k, replace=False)) for k in range(1, 25) for _ in range(4)], np.uint64)
    keys = np.unique((base[:, None] ^ flips[None, :]).ravel())
    root = {int(k): int(k) for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in zip(*np.nonzero(np.triu((np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 12) & ((keys[:, None] ^ keys[None, :]) >> np.uint64(48) == 0), 1)), strict=True):
        a, b = find(int(keys[i])), find(int(keys[j]))
        root[max(a, b)] = min(a, b)
    want = {k: find(k) for k in root}
    a, b = trie_links(keys, 12, 16, outright)
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert {k: got.get(k, k) for k in root} == want


def test_similar_texts_share_a_band_and_crowds_are_few_rows(spark):
    r = random.Random(2)
    rows = []
    for base in range(40):
        own = words(200, r)
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, near(own, 4, r))]  # a similarity of 0.815
    docs = spark.createDataFrame(rows, "rid long, text string").selectExpr("rid", "named_struct('doc_id', rid, 'text', text) AS row")
    prints = near_copies.signatures(docs).selectExpr("rid AS node", "CAST(NULL AS long) AS component", "CAST(NULL AS long) AS crowd", "print")
    bands = {}
    for x in near_copies.clusters(prints, len(rows), near_copies.PRINTS).collect():
        bands.setdefault(x.band, set()).add(x.node)
    assert all(any({d, d + 1} <= b for b in bands.values()) for d in range(0, len(rows), 2))
    # Those of one crowd or of one component make no band.
    for column in ("component", "crowd"):
        assert not near_copies.clusters(prints.withColumn(column, prints.node - prints.node % 2), len(rows), near_copies.PRINTS).count()
