"""Components of few edges in one task, of more by stars."""

import random

import numpy as np
import pytest

from lodeseam.llm import near_copies, simhash_dedup

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _graph():
    """Long paths in both directions, hubs, loops, repeats, the least and the largest number, random links."""
    random.seed(5)
    edges = [(k, k + 1) for k in range(70)] + [(-k, -k - 1) for k in range(200, 260)]
    edges += [(5000, 4000 + k) for k in range(50)] + [(1000, 2000 + k) for k in range(50)]
    edges += [(300, 300), (7, 7), (3, 4), (4, 3), (LOW, HIGH), (HIGH, 900)]
    return edges + [(random.randrange(10_000, 10_300), random.randrange(10_000, 10_300)) for _ in range(120)]


def _plain(edges):
    root = {x: x for e in edges for x in e}
    again = True
    while again:
        again = False
        for a, b in edges:
            least = min(root[a], root[b])
            again |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


@pytest.mark.parametrize("most", [None, 2])
@pytest.mark.parametrize("rows", [None, 300])
def test_one_task_and_stars_find_the_same(spark, most, rows):
    edges = _graph()
    frame, want = spark.createDataFrame(edges, "a long, b long"), _plain(edges)
    found = simhash_dedup.components(frame, most, rows).collect()
    assert len(found) == len(want) and dict(map(tuple, found)) == want
    for alone in (0, len(edges) // 2):  # fewer than there are: stars
        found = simhash_dedup.components(frame, None, rows, alone).collect()
        assert len(found) == len(want) and dict(map(tuple, found)) == want


def test_no_edges(spark):
    for alone in (0, simhash_dedup.ALONE):
        for edges in ([], [(1, 1)]):
            assert simhash_dedup.components(spark.createDataFrame(edges, "a long, b long"), alone=alone).count() == 0


def test_paths_of_any_length_are_joined_in_few_steps():
    ids = np.arange(400_000)
    for nodes in (ids, ids[::-1], np.random.default_rng(3).permutation(ids)):
        found, roots = simhash_dedup._rooted(nodes[1:], nodes[:-1])
        assert (found == ids).all() and not roots.any()


def _tasks(spark, run):
    """How many tasks it takes with many partitions that stay apart."""
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group := f"tasks-{random.random()}", "")
        run()
        status = spark.sparkContext.statusTracker()
        stages = {s for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds}
        return sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_edges_take_few_tasks(spark):
    """Tasks and their metrics are what fills a driver that has many partitions to look after."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert _tasks(spark, lambda: simhash_dedup.components(edges).collect()) < 61


def test_near_copies_take_few_tasks(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words, f"end{k}"]) for k in range(8)] + [" ".join(f"{k}x{j}" for j in range(40)) for k in range(8)]
    docs, kept = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    assert _tasks(spark, lambda: kept.extend(r.doc_id for r in near_copies.dedup(docs).collect())) < 45 * 61
    assert sorted(kept) == [0, *range(8, 16)]
