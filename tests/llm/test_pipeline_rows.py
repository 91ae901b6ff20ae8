"""The pipeline's rows against a plain restatement of its stages, with planted near copies and benchmark passages."""

import re
from collections import Counter

import brute
import pytest

import corpus_pipeline
from lodeseam.llm import queries as llm

TABLES = ("documents", "benchmark", "labels")


def similar(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets[0] == sets[1] or len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def planted(spark, small, tmp_path_factory):
    """A folder of the pipeline's tables whose documents hold near copies, and passages of the benchmark."""
    path = tmp_path_factory.mktemp("planted")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    long = [r for r in rows if len(brute.WS.findall(r["text"] or "")) > 250][:6]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").collect() if len(brute.ALNUM.findall(brute.lower(r.text or ""))) >= 13]
    new = []
    for k, r in enumerate(long):
        w = r["text"].split(" ")
        passage = " ".join(items[k % len(items)].split()[:40])
        new.append(r | {"doc_id": 900_000 + k, "text": " ".join([*w[:-3], "changed", "last", "words"])})
        new.append(r | {"doc_id": 910_000 + k, "text": r["text"].upper()})
        new.append(r | {"doc_id": 920_000 + k, "text": " ".join(f"{x}{k}" for x in w[:220]) + " " + passage})
        new.append(r | {"doc_id": 930_000 + k, "text": " ".join(f"{x}{k}z{j}" for j in range(12) for x in w) + " " + passage})
    assert len(long) > 2
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows + new], docs.schema).write.parquet(f"{path}/documents.parquet")
    for t in TABLES[1:]:
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_rows_of_the_pipeline(spark, planted):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{planted}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]

    # Quality: the base rules restated; the learned verdict is that of the operator's own query.
    verdict = {r.doc_id: r.kept for r in llm.queries()["op5_quality"](spark, planted).select("doc_id", "kept").collect()}
    good = {d for d in docs if verdict[d]}
    assert good and not any(brute.quality(docs[d].text)[-1] for d in good)
    first = corpus_pipeline.quality(spark, spark.read.parquet(f"{planted}/documents.parquet"), planted).collect()
    assert Counter(map(tuple, first)) == Counter(tuple(docs[d]) for d in good)

    # Near duplicates: all pairs.
    root = {d: d for d in good}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(good)
    for i, a in enumerate(order):
        for b in order[:i]:
            if find(a) != find(b) and similar(docs[a].text, docs[b].text):
                root[max(find(a), find(b))] = min(find(a), find(b))
    single = {d for d in good if root[d] == d}
    assert len(single) < len(good)

    # Decontamination: each word looked up.
    clean, cut = {}, {}
    for (d, n_words, n_hit, _, _, gone) in brute.contaminated([(d, docs[d].text) for d in single], items):
        if not gone:
            clean[d], cut[d] = n_words - n_hit, n_hit > 0
    assert len(clean) < len(single) and any(cut.values())

    # Mixture: every source near its target, none of its documents left out where the target holds all of them.
    rows = corpus_pipeline.run(spark, planted).collect()
    ids, text = Counter(r.doc_id for r in rows), {r.doc_id: r.text for r in rows}
    assert set(ids) <= set(clean)
    size = Counter()
    left = spark.read.parquet(f"{planted}/documents.parquet").filter(f"doc_id IN ({', '.join(map(str, single))})")
    kept = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, left, planted).collect()}
    assert set(kept) == set(clean)
    for d in kept:
        assert len(brute.ALNUM.findall(brute.lower(kept[d] or ""))) == clean[d] and (cut[d] or kept[d] == docs[d].text)
        size[docs[d].source] += len(brute.WS.findall(kept[d]))
    want, taken, largest = brute.targets(size), Counter(), Counter()
    for d, n in ids.items():
        assert text[d] == kept[d] and n <= 2
        words = len(brute.WS.findall(text[d]))
        taken[docs[d].source] += n * words
        largest[docs[d].source] = max(largest[docs[d].source], words)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert all(d in ids for d in kept if want[docs[d].source] >= size[docs[d].source])

    # Shards: counts at most one apart, slots without gaps.
    for shard in range(corpus_pipeline.SHARDS):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) - len(rows) // corpus_pipeline.SHARDS in (0, 1)
