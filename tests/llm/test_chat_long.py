"""Texts and conversations that are too long for Spark's JSON functions."""

from collections import Counter

import brute
from pyspark.sql import functions as F

from lodeseam.llm import chat_format


def test_long_text_and_large_conversation(spark):
    sizes = [(1, 0, "user", 5), (1, 1, "assistant", 21_000_000), *((2, k, ("user", "assistant")[k % 2], 1_000_000) for k in range(135))]
    rows = spark.createDataFrame(sizes, "conv_id long, turn long, role string, n int")
    turns = rows.select("conv_id", "turn", "role", F.repeat(F.lit("x"), F.col("n")).alias("text"))
    found = chat_format.digest(chat_format.formatted(chat_format.canonical(chat_format.records(turns))))
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    want = brute.chats([(c, t, r, "x" * n) for c, t, r, n in sizes])
    assert Counter(tuple(x) for x in found.select(*columns).collect()) == want
