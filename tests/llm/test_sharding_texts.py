"""The sharding query moves whole rows and reads size and checksum from the placed texts."""

from collections import Counter

import brute

from lodeseam.llm import queries, sharding


def test_query_places_texts(spark, small, monkeypatch):
    placed, place = [], sharding.place
    monkeypatch.setattr(sharding, "place", lambda *a, **k: placed.append(place(*a, **k)) or placed[-1])
    found = queries.op9_sharding(spark, small).select("doc_id", "size", "text_crc32").collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert set(docs.columns) <= set(placed[0].columns)
    assert Counter(map(tuple, found)) == brute.sizes([tuple(r) for r in docs.select("doc_id", "text").collect()])
