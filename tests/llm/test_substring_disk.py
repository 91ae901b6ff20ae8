"""What substring dedup leaves in the shared folder."""

import glob

from lodeseam.llm import substring_dedup
from lodeseam.llm._shared import shared_dir


def test_tables_of_the_levels_are_removed(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c {passage}"), (3, "alone")], "doc_id long, text string")
    top = shared_dir(spark).removeprefix("file://")
    found = lambda: set(glob.glob(f"{top}/**/rdd-*", recursive=True)) | set(glob.glob(f"{top}/repeated-*"))
    before = found()
    rows = substring_dedup.dedup(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 60), (2, 60), (3, 0)]
    assert len(found() - before) == 1  # the flags alone
    assert all(r.n_removed == 0 for r in substring_dedup.dedup(docs.filter("doc_id <> 2")).collect())
    assert len(found() - before) == 1
