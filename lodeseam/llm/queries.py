"""The queries of this subpackage, (spark, sf_dir) to a DataFrame, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import (
    chat_format,
    decontaminate,
    license_scan,
    mixing,
    quality_rules,
    sharding,
    simhash_dedup,
    sql,
    substring_dedup,
    token_output,
    url_filters,
)
from lodeseam.llm._shared import new_path, table

SHARDS = 8


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    token_output.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_output.checksums(token_output.read(spark, path))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# Dated list entries of the query: (domain, action, since).
URL_LIST = (
    ("spam-farm.example.org", "block", "2024-01-15"),
    ("spam-farm.example.org", "allow", "2024-05-01"),
    ("spam-farm.example.org", "block", "2024-09-10"),
    ("cheap-pills.example.com", "block", "2024-03-01"),
    ("example.net", "block", "2024-06-01"),
    ("example.net", "allow", "2024-07-15"),
    ("blog.example.net", "block", "2024-07-01"),
    ("example.org", "block", "2024-11-01"),
)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has no fetch time: page p was fetched p mod 366 days into 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    rows = ", ".join(str(x) for x in URL_LIST)
    entries = spark.sql(f"SELECT * FROM VALUES {rows} AS t(domain, action, since)")
    found = url_filters.apply(captures, entries)
    return found.select("page_id", "host", "domain", "action", F.col("since").cast("string").alias("since"), "blocked")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.place(table(spark, sf_dir, "documents"), SHARDS)
    none = F.lit(None).cast("int").alias("grown_shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))  # as it was placed
    size, crc32 = F.octet_length(text).cast("long") + 1, F.crc32(text.cast("binary"))
    return found.select("doc_id", size.alias("size"), crc32.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", none)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    lits = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for k, r in enumerate(("user", "assistant"))]
    added = spark.range(1).select(F.inline(F.array(*lits)))
    records = chat_format.records(turns.unionByName(added))
    return chat_format.digest(chat_format.formatted(chat_format.canonical(records)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_tokens, op3_licenses, op4_decontaminate, op5_quality, op6_substrings, op7_mixing, op8_url_filters, op9_sharding, op10_chat, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": sql.LICENSES,
        "op4_decontaminate": sql.DECONTAMINATE,
        "op6_substrings": sql.SUBSTRINGS,
        "op8_url_filters": sql.url_filters(URL_LIST),
        "op10_chat": sql.CHAT,
    }
