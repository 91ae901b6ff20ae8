"""The pipeline's near-duplicate stage against all pairs of texts, near copies of similarity 0.8 and more included."""

import random
from collections import Counter

import brute
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = brute.WS.findall(brute.lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """(doc_id, text) rows: of each component of similarity 0.8 the one with the least doc_id, rows without one last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            shared = len(x & y)
            if x == y or 10 * shared >= 8 * (len(x) + len(y) - shared):
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append((d is None, d or 0, i))
    return [min(group)[2] for group in best.values()]


def words(n, r):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def near(own, k, r):
    """own with k words, far apart, changed: five shingles each are new."""
    own = list(own)
    for i in range(k):
        own[(i + 1) * len(own) // (k + 1)] = f"new{r.randrange(10**6)}"
    return " ".join(own)


def planted():
    """Bases of 200 words with copies of similarity 0.95 to just under 0.8."""
    r, rows = random.Random(4), []
    for base in range(60):
        own = words(200, r)
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, near(own, 1 + base % 6, r))]
    return rows


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return Counter((x.doc_id, x.text) for x in out.collect())


def test_planted_near_copies_go(spark):
    rows = planted()
    want = Counter(rows[i] for i in survivors(rows))
    assert 60 < sum(want.values()) < 90
    assert kept(spark, rows) == want


def test_chains_and_a_large_group(spark):
    """Links through a middle text, and a group whose members are similar to few of the others."""
    r = random.Random(8)
    own = words(300, r)
    rows = [(100 + k, near(own, 3, random.Random(k)).replace("w", "W") if k % 2 else near(own, 1 + k % 6, random.Random(k))) for k in range(40)]
    chain = words(300, r)
    for k in range(8):
        rows.append((k, " ".join(chain)))
        chain[20 + 30 * k : 40 + 30 * k] = words(20, r)
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "one two")]
    assert kept(spark, rows) == Counter(rows[i] for i in survivors(rows))
