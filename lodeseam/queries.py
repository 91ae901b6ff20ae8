"""Queries over the driver's tables, (spark, sf_dir) to a DataFrame, each beside the SQL that says the same.

The tables hold text, so objects are made of it: `documents.text` behind the leading bytes of a format, or compressed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseam.functions import bytes as B
from lodeseam.functions import checksums, detect, headers, registry, scalars
from lodeseam.operators import base64_mime, codecs, lineage, walkers
from lodeseam.operators.deflate_walk import DeflateBlocks, analyse
from lodeseam.plans.engine import Engine
from lodeseam.plans.options import ScanOptions
from lodeseam.sources import container, objects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- objects out of documents ---------------------------------------------------------------------------------------

_STREAMINFO = "03E8" "1000" "000000" "000000" "0AC442F0000F4240" "000102030405060708090A0B0C0D0E0F"
# Leading bytes of object doc_id % 13.
PREFIXES = (
    "",
    "789C",
    "1F8B0800E8030000" "0203",
    "504B0304" "1400" "0000" "0800" "0000" "0000" "EFBEADDE" "64000000" "E8030000" "0500" "0300",
    "89504E470D0A1A0A" "0000000D49484452" "00000140" "000000F0" "0806000000",
    "FFD8",
    "474946383961" "8002" "E001" "F70000",
    "FFE0",
    "255044462D312E370A",
    "4357530A10000000" "789C",
    "5249464600100000" "57415645" "666D7420" "10000000" "0100" "0200" "44AC0000" "10B10200" "0400" "1000",
    "425A6839",
    "664C6143" "00000022" + _STREAMINFO,
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, content: every document behind one of PREFIXES."""
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("doc_id") % len(PREFIXES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("object_id"), objects.payload(F.col("text"), prefix).alias("content"))


_P = f"""p AS (SELECT doc_id AS object_id, unhex(list_extract([{', '.join(f"'{p}'" for p in PREFIXES)}], (doc_id % {len(PREFIXES)} + 1)::INT)) || encode(coalesce(text, '')) AS c FROM documents),
q AS (SELECT object_id, c, hex(c) AS h, octet_length(c) AS n FROM p)"""


def _b(i: int, of: str = "h") -> str:
    """Byte i in SQL."""
    return f"TRY_CAST('0x' || substr({of}, {2 * i + 1}, 2) AS INT)"


def _be(i: int, w: int) -> str:
    return f"TRY_CAST('0x' || substr(h, {2 * i + 1}, {2 * w}) AS BIGINT)"


def _le(i: int, w: int) -> str:
    return f"TRY_CAST('0x' || {' || '.join(f'substr(h, {2 * (i + k) + 1}, 2)' for k in reversed(range(w)))} AS BIGINT)"


_ZLIB = f"(({_b(0)} & 15) = 8 AND {_be(0, 2)} % 31 = 0)"
_IS = {
    "PDF": "starts_with(h, '255044462D')",
    "ZIP": f"(starts_with(h, '504B0304') AND n >= 30 AND substr(h, 17, 4) = '0800' AND {_le(26, 2)} + {_le(28, 2)} <= 4096)",
    "GZIP": f"(starts_with(h, '1F8B') AND n >= 10 AND ({_b(2)} & 15) = 8 AND ({_b(3)} & 224) = 0)",
    "PNG": "starts_with(h, '89504E470D0A1A0A')",
    "GIF": "(starts_with(h, '474946383761') OR starts_with(h, '474946383961'))",
    "SWF": f"(starts_with(h, '435753') AND n >= 11 AND ({_b(8)} & 15) = 8 AND {_be(8, 2)} % 31 = 0 AND ({_b(9)} & 32) = 0)",
    "BASE64": "(substr(h, 3, 8) = '6F6E7465' AND FALSE)",
    "BZIP2": f"(starts_with(h, '425A68') AND {_b(3)} BETWEEN 49 AND 57)",
    "WAV": "(starts_with(h, '52494646') AND substr(h, 17, 8) = '57415645')",
    "FLAC": f"(starts_with(h, '664C6143') AND n >= 8 AND ({_b(4)} & 127) = 0)",
    "JPG": "starts_with(h, 'FFD8')",
    "MP3": f"({_b(0)} = 255 AND ({_b(1)} & 224) = 224)",
    "ZLIB": f"({_ZLIB} AND ({_b(1)} & 32) = 0)",
    "D_BRUTE": f"({_ZLIB} AND {_b(0)} < 128)",
}


def _chain(value: Callable[[str, int], int], names=None) -> str:
    rules = [r for r in detect.RULES if names is None or r[0] in names]
    return "CASE " + " ".join(f"WHEN {_IS[n]} THEN {value(n, sure)}" for n, _, sure in rules) + " ELSE 0 END"


_FORMAT = _chain(lambda n, _: registry.ID[n])

# --- detection ------------------------------------------------------------------------------------------------------


@query(f"WITH {_P} SELECT format, count(*) AS n, sum(n)::BIGINT AS bytes FROM (SELECT {_FORMAT} AS format, n FROM q) GROUP BY format")
def detect_counts(spark, sf_dir):
    """The flagship: formats of all objects, counted."""
    rows = payloads(spark, sf_dir)
    found = rows.select(detect.detect(F.col("content"))["format"].alias("format"), B.size(F.col("content")).alias("size"))
    return found.groupBy("format").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


@query(f"WITH {_P} SELECT object_id, {_FORMAT} > 0 AS is_match, {_chain(lambda _, s: s)} AS confidence, {_FORMAT} AS format FROM q")
def detect_rows(spark, sf_dir):
    rows = payloads(spark, sf_dir).select("object_id", detect.detect(F.col("content")).alias("d"))
    return rows.select("object_id", "d.is_match", "d.confidence", "d.format")


@query("WITH " + _P + " SELECT object_id, " + ", ".join(f"coalesce({sql}, FALSE) AS is_{n.lower()}" for n, sql in _IS.items()) + " FROM q")
def predicates(spark, sf_dir):
    return payloads(spark, sf_dir).select("object_id", *(F.coalesce(rule(F.col("content")), F.lit(False)).alias(f"is_{n.lower()}") for n, rule, _ in detect.RULES))


@query(f"WITH {_P} SELECT format, count(*) AS n FROM (SELECT {_chain(lambda n, _: registry.ID[n], ('PDF', 'PNG', 'GZIP'))} AS format FROM q) GROUP BY format")
def type_switch(spark, sf_dir):
    """Only the formats that the switch names."""
    found = payloads(spark, sf_dir).select(detect.detect(F.col("content"), detect.switched("t+png"))["format"].alias("format"))
    return found.groupBy("format").agg(F.count("*").alias("n"))


@query(f"WITH {_P} SELECT object_id, starts_with(h, '1F8B') AS may_be_gzip, coalesce({_ZLIB} AND {_b(0)} < 128 AND (({_b(1)} & 32) = 0 OR n >= 6), FALSE) AS is_zlib_stream, starts_with(h, '5043461A') AND n >= 8 AS is_container FROM q")
def weak_predicates(spark, sf_dir):
    c = F.col("content")
    return payloads(spark, sf_dir).select("object_id", detect.may_be_gzip(c).alias("may_be_gzip"), detect.is_zlib_stream(c).alias("is_zlib_stream"), detect.is_container(c).alias("is_container"))


# --- headers --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_P} SELECT object_id, {_b(2)} AS method, {_b(3)} AS flags, {_le(4, 4)} AS mtime, {_b(8)} AS extra_flags, {_b(9)} AS os_type,
CASE WHEN ({_b(8)} & 4) <> 0 THEN 1 WHEN ({_b(8)} & 2) <> 0 THEN 9 ELSE 6 END AS level,
CASE WHEN {_b(9)} <= 13 THEN list_extract([{', '.join(f"'{x}'" for x in registry.GZIP_OS)}], {_b(9)} + 1) ELSE 'Unknown' END AS os_name
FROM q WHERE {_IS['GZIP']}""")
def gzip_headers(spark, sf_dir):
    rows = payloads(spark, sf_dir).filter(detect.is_gzip(F.col("content"))).select("object_id", headers.gzip_fixed(F.col("content")).alias("g"))
    return rows.select("object_id", "g.method", "g.flags", "g.mtime", "g.extra_flags", "g.os_type", "g.level", registry.gzip_os(F.col("g.os_type")).alias("os_name"))


@query(f"""WITH {_P} SELECT object_id, {_b(0)} AS cmf, {_b(1)} AS flg, {_b(0)} & 15 AS method, ({_b(0)} >> 4) + 8 AS window_bits,
list_extract([1, 3, 6, 9], ({_b(1)} >> 6) + 1) AS level, ({_b(1)} & 32) <> 0 AS has_dictionary, n - 2 AS compressed_size FROM q WHERE {_IS['ZLIB']}""")
def zlib_headers(spark, sf_dir):
    rows = payloads(spark, sf_dir).filter(detect.is_zlib(F.col("content"))).select("object_id", headers.zlib_header(F.col("content")).alias("z"))
    return rows.select("object_id", "z.cmf", "z.flg", "z.method", "z.window_bits", "z.level", "z.has_dictionary", F.col("z.compressed_size").cast("long").alias("compressed_size"))


@query(f"WITH {_P} SELECT object_id, {_b(3)} AS block_size_indicator, ({_b(3)} - 48) * 100000 AS block_size, {_b(3)} - 48 AS level, (({_b(3)} - 48) * 100)::VARCHAR || ' kB' AS description FROM q WHERE {_IS['BZIP2']}")
def bzip2_headers(spark, sf_dir):
    rows = payloads(spark, sf_dir).filter(detect.is_bzip2(F.col("content"))).select("object_id", headers.bzip2_header(F.col("content")).alias("z"))
    return rows.select("object_id", "z.block_size_indicator", "z.block_size", "z.level", "z.description")


@query(f"WITH {_P} SELECT object_id, CASE WHEN {_IS['BZIP2']} THEN {_b(3)} - 48 ELSE -1 END AS level FROM q")
def bzip2_levels(spark, sf_dir):
    return payloads(spark, sf_dir).select("object_id", detect.bzip2_level(F.col("content")).cast("int").alias("level"))


@query(f"""WITH {_P} SELECT object_id, {_le(8, 2)}::INT AS method, {_le(14, 4)} AS crc32, {_le(18, 4)} AS compressed_size, {_le(22, 4)} AS uncompressed_size,
{_le(26, 2)}::INT AS name_length, {_le(28, 2)}::INT AS extra_length, (30 + {_le(26, 2)} + {_le(28, 2)})::INT AS header_length FROM q WHERE {_IS['ZIP']}""")
def zip_headers(spark, sf_dir):
    rows = payloads(spark, sf_dir).filter(detect.is_zip(F.col("content"))).select("object_id", headers.zip_header(F.col("content")).alias("z"))
    return rows.select("object_id", "z.*")


@query(f"""WITH {_P} SELECT object_id, {_be(8, 2)}::INT AS min_block, {_be(10, 2)}::INT AS max_block, ({_be(18, 3)} >> 4)::INT AS sample_rate,
(({_b(20)} >> 1) & 7) + 1 AS channels, ((({_b(20)} & 1) << 4) | ({_b(21)} >> 4)) + 1 AS bits_per_sample,
(({_b(21)} & 15)::BIGINT * 4294967296) + {_be(22, 4)} AS total_samples, lower(substr(h, 53, 32)) AS md5,
CASE WHEN {_be(10, 2)} >= 4096 THEN 8 WHEN {_be(10, 2)} >= 2048 THEN 5 ELSE 0 END AS level FROM q WHERE {_IS['FLAC']} AND n >= 42""")
def flac_streaminfo(spark, sf_dir):
    rows = payloads(spark, sf_dir).select("object_id", headers.flac_streaminfo(F.col("content")).alias("f")).filter("f IS NOT NULL")
    return rows.select("object_id", "f.min_block", "f.max_block", "f.sample_rate", "f.channels", "f.bits_per_sample", "f.total_samples", F.lower(F.hex("f.md5")).alias("md5"), "f.level")


@query(f"""WITH {_P} SELECT object_id, {_le(20, 2)}::INT AS audio_format, {_le(22, 2)}::INT AS channels, {_le(24, 4)}::INT AS sample_rate, {_le(28, 4)} AS byte_rate,
{_le(32, 2)}::INT AS block_align, {_le(34, 2)}::INT AS bits_per_sample FROM q WHERE {_IS['WAV']} AND substr(h, 25, 8) = '666D7420' AND n >= 44""")
def wav_formats(spark, sf_dir):
    rows = payloads(spark, sf_dir).select("object_id", headers.wav_format(F.col("content")).alias("w")).filter("w IS NOT NULL")
    return rows.select("object_id", "w.*")


@query(f"""WITH {_P} SELECT object_id, 'PNG' AS kind, {_be(16, 4)} AS width, {_be(20, 4)} AS height, {_b(24)} AS detail FROM q WHERE {_IS['PNG']}
UNION ALL SELECT object_id, 'GIF', {_le(6, 2)}, {_le(8, 2)}, {_b(10)} FROM q WHERE {_IS['GIF']}""")
def image_headers(spark, sf_dir):
    c, rows = F.col("content"), payloads(spark, sf_dir)
    png = rows.filter(detect.is_png(c)).select("object_id", F.lit("PNG").alias("kind"), headers.png_header(c).alias("p")).select("object_id", "kind", "p.width", "p.height", F.col("p.bit_depth").alias("detail"))
    gif = rows.filter(detect.is_gif(c)).select("object_id", F.lit("GIF").alias("kind"), headers.gif_header(c).alias("g"), B.byte(c, 10).alias("detail"))
    return png.unionAll(gif.select("object_id", "kind", F.col("g.width").cast("long"), F.col("g.height").cast("long"), "detail"))


@query("SELECT doc_id AS object_id, '1.' || doc_id % 8 AS version FROM documents WHERE doc_id % 3 > 0")
def pdf_versions(spark, sf_dir):
    """Of documents behind a version of their own, or behind none."""
    head = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("%PDF-1."), F.col("doc_id") % 8, F.lit("\n"))).otherwise("")
    c, docs = F.col("content"), table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("object_id"), F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    return rows.filter(detect.is_pdf(c)).select("object_id", headers.pdf_version(c).alias("version"))


_COUNTS = "(l_orderkey % 4)::BIGINT AS s, (l_partkey % 5)::BIGINT AS f, (l_suppkey % 6)::BIGINT AS d, (257 + l_partkey % 30)::BIGINT AS lit, (1 + l_suppkey % 30)::BIGINT AS dist"
_LEVEL = "CASE WHEN s * 2 > s + f + d THEN 1 WHEN f > d THEN 3 WHEN d > 0 THEN CASE WHEN lit > 280 OR dist > 28 THEN 7 ELSE 5 END ELSE 6 END"


@query(f"SELECT level, name, count(*) AS n FROM (SELECT level, list_extract([{', '.join(repr(registry.LEVELS[k]) for k in range(1, 10))}], level) AS name FROM (SELECT {_LEVEL} AS level FROM (SELECT {_COUNTS} FROM lineitem))) GROUP BY level, name")
def deflate_levels(spark, sf_dir):
    """The level heuristic over made-up block counts."""
    line = table(spark, sf_dir, "lineitem")
    level = headers.deflate_level(F.col("l_orderkey") % 4, F.col("l_partkey") % 5, F.col("l_suppkey") % 6, 257 + F.col("l_partkey") % 30, 1 + F.col("l_suppkey") % 30)
    return line.select(level.alias("level")).groupBy("level").agg(F.count("*").alias("n")).select("level", registry.level_name(F.col("level")).alias("name"), "n")


@query(f"WITH {_P} SELECT object_id, lower(substr(h, 1, 20)) AS header FROM q WHERE {_IS['GZIP']}")
def gzip_headers_again(spark, sf_dir):
    """Headers put together again from their fields."""
    c = F.col("content")
    rows = payloads(spark, sf_dir).filter(detect.is_gzip(c)).select("object_id", headers.gzip_fixed(c).alias("g"))
    none = F.lit(None).cast("binary")
    made = headers.gzip_header_bytes(F.col("g.flags"), F.col("g.mtime"), F.col("g.extra_flags"), F.col("g.os_type"), none, none.cast("string"), none.cast("string"), F.lit(0))
    return rows.select("object_id", F.lower(F.hex(made)).alias("header"))


@query(f"WITH {_P} SELECT object_id, substr(h, 1, 4) AS zlib, NULL::VARCHAR AS bzip2 FROM q WHERE {_IS['ZLIB']} UNION ALL SELECT object_id, NULL, substr(h, 1, 8) FROM q WHERE {_IS['BZIP2']}")
def stream_headers_again(spark, sf_dir):
    c, rows, none = F.col("content"), payloads(spark, sf_dir), F.lit(None).cast("string")
    z = rows.filter(detect.is_zlib(c)).select("object_id", F.hex(headers.zlib_header_bytes(c)).alias("zlib"), none.alias("bzip2"))
    return z.unionAll(rows.filter(detect.is_bzip2(c)).select("object_id", none, F.hex(headers.bzip2_header_bytes(detect.bzip2_level(c)))))


# --- checksums ------------------------------------------------------------------------------------------------------

_BYTES = "SELECT object_id, n, TRY_CAST('0x' || substr(h, (2 * i - 1)::INT, 2) AS BIGINT) AS v, i FROM (SELECT object_id, n, h, unnest(range(1, n + 1)) AS i FROM q)"


@query(f"WITH {_P}, v AS ({_BYTES}) SELECT object_id, (n + sum((n - i + 1) * v))::BIGINT % 65521 * 65536 + (1 + sum(v))::BIGINT % 65521 AS adler32 FROM v GROUP BY object_id, n")
def adler32(spark, sf_dir):
    return payloads(spark, sf_dir).select("object_id", checksums.adler32(F.col("content")).cast("long").alias("adler32"))


@query(f"WITH {_P}, v AS ({_BYTES}) SELECT object_id, v::INT AS byte, count(*) AS n FROM v GROUP BY object_id, v")
def byte_histogram(spark, sf_dir):
    return checksums.histogram(payloads(spark, sf_dir))


@query(f"WITH {_P}, v AS ({_BYTES}), c AS (SELECT object_id, v, count(*) AS k FROM v GROUP BY object_id, v) SELECT object_id, max(k) / sum(k) <= 0.2 AS plausible FROM c GROUP BY object_id")
def plausible_content(spark, sf_dir):
    return checksums.plausible(payloads(spark, sf_dir), 0.2).select("object_id", "plausible")


@query()
def crc_checks(spark, sf_dir):
    """CRC-32, that of bzip2, CRC-16, and a gzip header's checksum: SQL has none of them."""
    c = F.col("content")
    return payloads(spark, sf_dir).select("object_id", checksums.crc32(c).alias("crc32"), checksums.crc32_bzip2(c).alias("crc32_bzip2"), checksums.crc16(c).alias("crc16"), checksums.gzip_header_crc(B.part(c, 0, 10)).alias("header_crc"))


# --- integers and strings in bytes ----------------------------------------------------------------------------------


@query(f"WITH {_P} SELECT object_id, {_be(0, 2)} AS be16, {_be(0, 3)} AS be24, {_be(0, 4)} AS be32, {_le(0, 2)} AS le16, {_le(0, 4)} AS le32, n::BIGINT AS length FROM q")
def integers(spark, sf_dir):
    c = F.col("content")
    return payloads(spark, sf_dir).select("object_id", B.uint_be(c, 0, 2).alias("be16"), B.uint_be(c, 0, 3).alias("be24"), B.uint_be(c, 0, 4).alias("be32"), B.uint_le(c, 0, 2).alias("le16"), B.uint_le(c, 0, 4).alias("le32"), B.size(c).cast("long").alias("length"))


@query("SELECT p_partkey, p_name AS name, p_brand AS brand FROM part")
def null_terminated_strings(spark, sf_dir):
    """Two strings read back from name 0 brand 0."""
    part = table(spark, sf_dir, "part")
    c = F.concat(F.encode("p_name", "UTF-8"), B.literal("00"), F.encode("p_brand", "UTF-8"), B.literal("00"))
    rows = part.select("p_partkey", c.alias("c")).withColumn("name", B.null_terminated(F.col("c"), F.lit(0)))
    rows = rows.withColumn("brand", B.null_terminated(F.col("c"), F.octet_length("name") + 1))
    return rows.select("p_partkey", F.decode("name", "UTF-8").alias("name"), F.decode("brand", "UTF-8").alias("brand"))


# --- codecs ---------------------------------------------------------------------------------------------------------


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@query("SELECT doc_id, codec, TRUE AS same, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents, (VALUES ('deflate'), ('zlib'), ('gzip'), ('bzip2')) AS t(codec)")
def codec_round_trips(spark, sf_dir):
    """Each text packed at level doc_id % 9 + 1 and expanded again."""
    rows, out = _texts(spark, sf_dir), None
    for codec in codecs.DECODERS:
        made = rows.withColumn("packed", codecs.pack(F.col("content"), codec, F.col("doc_id") % 9 + 1)).withColumn("out", codecs.expand(F.col("packed"), codec))
        same = codecs.verified(F.col("content"), F.col("out.content"), F.col("out.crc32"))
        own = made.select("doc_id", F.lit(codec).alias("codec"), same.alias("same"), F.octet_length("out.content").cast("long").alias("size"))
        out = own if out is None else out.unionAll(own)
    return out


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} END::INT AS code, CASE WHEN doc_id % 3 = 2 THEN text END AS text FROM documents".format(codecs.TRUNCATED, codecs.CORRUPT))
def truncated_streams(spark, sf_dir):
    """Streams without their last byte, or with another first one, are errors of their rows; the others expand."""
    rows = _texts(spark, sf_dir).select("doc_id", codecs.pack(F.col("content"), "zlib", 6).alias("packed"))
    p, kind = F.col("packed"), F.col("doc_id") % 3
    made = F.when(kind == 0, B.part(p, 0, B.size(p) - 1)).when(kind == 1, F.concat(B.literal("FF"), B.part(p, 1, B.size(p)))).otherwise(p)
    out = rows.select("doc_id", codecs.expand(made, "zlib").alias("out"))
    return out.select("doc_id", F.col("out.error.code").alias("code"), F.decode("out.content", "UTF-8").alias("text"))


@query()
def deflate_gains(spark, sf_dir):
    """Where compressing pays; sizes are the library's."""
    rows = _texts(spark, sf_dir).withColumn("packed", codecs.pack(F.col("content"), "zlib", 9))
    return rows.select("doc_id", codecs.gains(F.col("content"), F.col("packed")).alias("gains"), F.octet_length("packed").alias("packed_size"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS output_bytes, NULL::VARCHAR AS error FROM documents")
def deflate_analyses(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", analyse(codecs.pack(F.col("content"), "deflate", F.col("doc_id") % 9 + 1)).alias("a"))
    return rows.select("doc_id", "a.output_bytes", "a.error")


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, TRUE AS ends FROM documents")
def deflate_blocks(spark, sf_dir):
    """A row a block, summed up again for each text."""
    rows = _texts(spark, sf_dir).select("doc_id", codecs.pack(F.col("content"), "deflate", 9).alias("packed"))
    blocks = rows.lateralJoin(DeflateBlocks(F.col("packed").outer()))
    return blocks.groupBy("doc_id").agg(F.sum("output_bytes").alias("bytes"), F.bool_or("last").alias("ends"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN lang END AS filename, CASE WHEN doc_id % 3 = 1 THEN source END AS comment,
(10 + CASE WHEN doc_id % 2 = 1 THEN length(lang) + 1 ELSE 0 END + CASE WHEN doc_id % 3 = 1 THEN length(source) + 1 ELSE 0 END)::INT AS header_length, doc_id % 100000 AS mtime FROM documents""")
def gzip_named_headers(spark, sf_dir):
    """Headers with names and comments, put together and parsed again."""
    docs = table(spark, sf_dir, "documents")
    flags = F.when(F.col("doc_id") % 2 == 1, 8).otherwise(0) + F.when(F.col("doc_id") % 3 == 1, 16).otherwise(0)
    head = headers.gzip_header_bytes(flags, F.col("doc_id") % 100000, F.lit(0), F.lit(3), F.lit(None).cast("binary"), F.col("lang"), F.col("source"), F.lit(0))
    rows = docs.select("doc_id", codecs.gzip_header(F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("g"))
    return rows.select("doc_id", "g.filename", "g.comment", "g.header_length", "g.mtime")


# --- MIME base64 ----------------------------------------------------------------------------------------------------

_HEAD = "Content-Transfer-Encoding: base64\r\n\r\n"


def _mime(spark, sf_dir) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    lengths = F.transform(F.sequence(F.lit(1), F.ceil(F.octet_length(text) / 57).cast("int")), lambda _: F.lit(76))
    body = F.when(F.octet_length(text) > 0, base64_mime.wrap(text, lengths)).otherwise("")
    docs = table(spark, sf_dir, "documents")
    made = F.encode(F.concat(F.lit(_HEAD), body, F.lit("\r\n")), "ISO-8859-1")
    return lineage.cut(docs.select(F.col("doc_id").alias("object_id"), made.alias("content")))  # scanned, not made anew for each filter


_B64 = "(4 * ceil(octet_length(encode(text)) / 3.0))::BIGINT"


@query(f"""SELECT doc_id AS object_id, 37 AS header_length, CASE WHEN {_B64} <= 76 OR {_B64} % 76 = 0 THEN 0 ELSE 1 END AS line_case,
ceil({_B64} / 76.0)::INT AS n_lines, text AS decoded, ({_B64} + 2 * ceil({_B64} / 76.0))::INT AS identical, TRUE AS accepted FROM documents WHERE octet_length(encode(text)) > 0""")
def base64_decoded(spark, sf_dir):
    found = base64_mime.decode(_mime(spark, sf_dir)).filter("octet_length(decoded) > 0")
    return found.select("object_id", "header_length", "line_case", F.size("line_len").alias("n_lines"), F.decode("decoded", "UTF-8").alias("decoded"), "identical", "accepted")


@query("SELECT doc_id AS object_id, TRUE AS same FROM documents WHERE octet_length(encode(text)) > 0")
def base64_rebuilt(spark, sf_dir):
    own = _mime(spark, sf_dir)
    again = base64_mime.rebuild(base64_mime.decode(own).filter("accepted")).select("object_id", F.col("content").alias("again"))
    return own.join(again, "object_id").select("object_id", codecs.verified(F.col("content"), F.col("again")).alias("same"))


@query("SELECT c AS character, CASE WHEN c = '=' THEN 64 WHEN instr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', c) > 0 THEN instr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', c) - 1 ELSE 65 END::INT AS value, count(*) AS n FROM (SELECT substr(props, 2, 1) AS c FROM events UNION ALL SELECT substr(event_type, 1, 1) FROM events UNION ALL SELECT substr(p_name, 3, 1) FROM part) GROUP BY c")
def base64_values(spark, sf_dir):
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    c = events.select(F.substring("props", 2, 1).alias("character")).unionAll(events.select(F.substring("event_type", 1, 1))).unionAll(part.select(F.substring("p_name", 3, 1)))
    return c.groupBy("character").agg(F.count("*").alias("n")).withColumn("value", base64_mime.character_value(F.col("character")).cast("int"))


@query("SELECT doc_id, least(length(text), doc_id % 500)::INT AS identical FROM documents WHERE text IS NOT NULL")
def identical_prefixes(spark, sf_dir):
    """A text and the same with everything from doc_id % 500 on replaced by a character that no text has."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    other = docs.select("doc_id", F.concat(F.substring("text", F.lit(1), (F.col("doc_id") % 500).cast("int")), F.lit("\u0001\u0001")).alias("other"))
    return docs.join(other, "doc_id").select("doc_id", base64_mime.common_prefix(F.col("text"), F.col("other")).alias("identical"))


# --- walkers --------------------------------------------------------------------------------------------------------


def _chunks(spark, sf_dir, head: str, chunk: Callable) -> DataFrame:
    """object_id, content: head and 1 to 3 chunks, of (doc_id + k) % 7 bytes for chunk k."""
    n = F.col("doc_id")
    parts = [F.when(k <= n % 3, chunk(k, (n + k) % 7, k == n % 3)).otherwise(B.literal("")) for k in range(3)]
    return table(spark, sf_dir, "documents").select(n.alias("object_id"), F.concat(B.literal(head), *parts).alias("content"))


def _byte(value) -> F.Column:
    return F.unhex(F.lpad(F.hex(value), 2, "0"))


_CHUNKS = "SELECT doc_id AS object_id, k, (doc_id + k) % 7 AS s, k = doc_id % 3 AS last FROM documents, range(3) AS r(k) WHERE k <= doc_id % 3"


@query(f"""SELECT object_id, k::INT AS idx, 'ck0' || k AS tag, (20 + coalesce(sum(8 + s + s % 2) OVER (PARTITION BY object_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", s::BIGINT AS size FROM ({_CHUNKS})""")
def riff_chunks(spark, sf_dir):
    """Chunks of row-dependent numbers and sizes, odd ones padded."""
    tag = lambda k: B.literal(f"ck0{k}".encode().hex())
    made = _chunks(spark, sf_dir, "524946460000000057415645", lambda k, s, last: F.concat(tag(k), _byte(s), B.literal("000000"), F.encode(F.repeat(F.lit("x"), (s + s % 2).cast("int")), "UTF-8")))
    rows = made.filter(detect.is_wav(F.col("content")))
    return rows.lateralJoin(walkers.RiffChunks(F.col("content").outer())).select("object_id", "idx", "tag", "offset", "size")


# Chunk k of an object is of type (object_id + k) % 7, so any of the seven may stand anywhere behind STREAMINFO.
def _flac(spark, sf_dir) -> DataFrame:
    kind = lambda k, last: (F.col("doc_id") + k) % 7 + F.when(last, 128).otherwise(0)
    made = _chunks(spark, sf_dir, "664C6143" + "00000022" + _STREAMINFO, lambda k, s, last: F.concat(_byte(kind(k, last)), B.literal("0000"), _byte(s), F.encode(F.repeat(F.lit("x"), s.cast("int")), "UTF-8")))
    return made.filter(detect.is_flac(F.col("content"))).lateralJoin(walkers.FlacBlocks(F.col("content").outer()))


@query(f"""SELECT object_id, k::INT + 1 AS idx, s::INT AS block_type, (46 + coalesce(sum(4 + s) OVER (PARTITION BY object_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", s::BIGINT AS size, last FROM ({_CHUNKS})
UNION ALL SELECT doc_id, 0, 0, 8, 34, FALSE FROM documents""")
def flac_blocks(spark, sf_dir):
    """Metadata blocks of row-dependent numbers, types and sizes."""
    return _flac(spark, sf_dir).select("object_id", "idx", "block_type", "offset", "size", "last")


@query(f"""SELECT object_id, bool_or(s = 3) AS has_seektable, bool_or(s = 4) AS has_vorbis_comment, bool_or(s = 5) AS has_cuesheet, bool_or(s = 6) AS has_picture,
coalesce(sum(s) FILTER (WHERE s = 1), 0)::BIGINT AS padding FROM ({_CHUNKS}) GROUP BY object_id""")
def flac_summaries(spark, sf_dir):
    """What kinds of blocks an object has, and the bytes of its padding."""
    return walkers.flac_summary(_flac(spark, sf_dir))


@query()
def gif_records(spark, sf_dir):
    rows = payloads(spark, sf_dir).filter(detect.is_gif(F.col("content")))
    return rows.lateralJoin(walkers.GifRecords(F.col("content").outer())).select("object_id", "idx", "kind", "offset", "size", "detail")


@query("SELECT doc_id, 1 AS n FROM documents WHERE octet_length(encode(text)) > 0")
def bzip2_blocks(spark, sf_dir):
    rows = _texts(spark, sf_dir).filter(F.octet_length("content") > 0).select("doc_id", codecs.pack(F.col("content"), "bzip2", 9).alias("packed"))
    blocks = rows.lateralJoin(walkers.Bzip2Blocks(F.col("packed").outer()))
    return blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT doc_id AS object_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS offset, 4 AS format, 100 AS confidence FROM documents")
def embedded_headers(spark, sf_dir):
    """A PNG signature behind each text and a line feed."""
    c = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), B.literal("0A89504E470D0A1A0A"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), c.alias("content"))
    found = rows.lateralJoin(walkers.EmbeddedHeaders(F.col("content").outer()))
    return found.filter("format = 4").select("object_id", "offset", "format", "confidence")


# --- streams --------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def ignored_positions(spark, sf_dir):
    """Rows whose position isn't on the ignore list: line items by part."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("offset"))
    ignored = table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("offset"))
    return lineage.without_ignored(rows, ignored).select("l_orderkey", "l_linenumber")


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS object_id, o_orderkey AS "offset", 1 + o_orderkey % 997 AS length, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
t AS (SELECT object_id, "offset", length, k, "offset" + length AS e, TRUE AS taken FROM r WHERE k = 1
UNION ALL SELECT r.object_id, r."offset", r.length, r.k, CASE WHEN r."offset" >= t.e THEN r."offset" + r.length ELSE t.e END, r."offset" >= t.e FROM t JOIN r ON r.object_id = t.object_id AND r.k = t.k + 1)
SELECT object_id, "offset", length FROM t WHERE taken""")
def greedy_streams(spark, sf_dir):
    """Overlapping ranges thinned out from the left: a customer's orders as ranges."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("offset"), (1 + F.col("o_orderkey") % 997).alias("length"))
    return lineage.greedy(rows)


@query("SELECT p_partkey, p_size AS identical FROM part WHERE p_size > 4")
def long_enough(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.filter(lineage.long_enough(F.col("p_size"), ScanOptions())).select("p_partkey", F.col("p_size").alias("identical"))


def _nested(spark, sf_dir) -> DataFrame:
    """object_id, content: each text packed doc_id % 4 times, zlib in gzip in bzip2."""
    rows = _texts(spark, sf_dir).select(F.col("doc_id").alias("object_id"), "content")
    for k, codec in enumerate(("zlib", "gzip", "bzip2")):
        deeper = F.col("object_id") % 4 > k
        packed = codecs.pack(F.when(deeper, F.col("content")), codec, 6)
        rows = rows.withColumn("content", F.when(deeper, packed).otherwise(F.col("content")))
    return lineage.cut(rows)  # as a table that is scanned: else its expressions would be repeated in every rule


@query("""SELECT doc_id AS object_id, d::INT AS depth, CASE (doc_id % 4 - d)::INT WHEN 0 THEN 11 WHEN 1 THEN 3 ELSE 10 END AS format FROM documents, range(1, 4) AS t(d) WHERE doc_id % 4 >= d""")
def nested_streams(spark, sf_dir):
    """Streams in streams, level by level."""
    found = lineage.expand_all(_nested(spark, sf_dir), ScanOptions(max_depth=10)).filter("error IS NULL")
    return found.select("object_id", "depth", "format")


@query("""WITH s AS (SELECT doc_id AS object_id, d::INT AS depth, CASE (doc_id % 4 - d)::INT WHEN 0 THEN 11 WHEN 1 THEN 3 ELSE 10 END AS format FROM documents, range(1, 3) AS t(d) WHERE doc_id % 4 >= d)
SELECT format, count(*) AS decompressed_count, max(depth)::INT AS deepest, bool_or(depth >= 2) AS limit_reached FROM s GROUP BY format""")
def stream_statistics(spark, sf_dir):
    options = ScanOptions(max_depth=2)
    found = lineage.expand_all(_nested(spark, sf_dir), options).filter("error IS NULL")
    found = found.withColumn("accepted", F.lit(True)).withColumn("level", F.lit(6))
    return lineage.statistics(found, options).select("format", "decompressed_count", "deepest", "limit_reached")


@query("SELECT count(*) FILTER (WHERE doc_id % 4 = 1) AS zlib_decompressed, count(*) FILTER (WHERE doc_id % 4 = 1) AS zlib_recompressed, count(*) FILTER (WHERE doc_id % 4 = 2) AS gzip_decompressed, count(*) FILTER (WHERE doc_id % 4 = 2) AS gzip_recompressed, count(*) FILTER (WHERE doc_id % 4 = 3) AS bzip2_decompressed, count(*) FILTER (WHERE doc_id % 4 = 3) AS bzip2_recompressed FROM documents")
def wide_statistics(spark, sf_dir):
    own = Engine(spark)
    return lineage.wide(own.statistics(own.precompress(_nested(spark, sf_dir))), {11: "ZLIB", 3: "GZIP", 10: "BZIP2"})


@query("SELECT doc_id AS object_id, CASE (doc_id % 4)::INT WHEN 1 THEN 11 WHEN 2 THEN 3 ELSE 10 END AS format, TRUE AS accepted, TRUE AS verified, CASE (doc_id % 4)::INT WHEN 3 THEN 6 ELSE 6 END AS level FROM documents WHERE doc_id % 4 > 0")
def precompressed(spark, sf_dir):
    """Each object's outermost stream, with parameters that give back its bytes."""
    return Engine(spark).precompress(_nested(spark, sf_dir)).select("object_id", "format", "accepted", "verified", "level")


@query("SELECT k::INT AS kind, coalesce(bool_or(k > 0) FILTER (WHERE doc_id IS NOT NULL), FALSE) AS anything_was_used, coalesce(bool_or(k = 3) FILTER (WHERE doc_id IS NOT NULL), FALSE) AS non_zlib_was_used FROM range(4) AS r(k) LEFT JOIN documents ON doc_id % 4 = k GROUP BY k")
def stream_usage(spark, sf_dir):
    """Of objects that aren't packed, or with zlib, gzip or bzip2 outermost."""
    found = Engine(spark).precompress(_nested(spark, sf_dir))
    rows = [lineage.usage(found.filter(F.col("object_id") % 4 == k)).withColumn("kind", F.lit(k)) for k in range(4)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


def _embedding(spark, sf_dir) -> DataFrame:
    """object_id, content: a text, and behind it in doc_id % 4 lines a gzip file, a bzip2 file and a MIME base64 part."""
    t, n = F.col("t"), F.col("object_id") % 4
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("object_id"), F.encode(F.concat(F.lit("document "), "doc_id", F.lit(": "), F.coalesce("text", F.lit(""))), "UTF-8").alias("t"))
    rows = rows.withColumn("gzip", codecs.pack(F.when(n > 0, t), "gzip", F.col("object_id") % 9 + 1))
    rows = rows.withColumn("bzip2", codecs.pack(F.when(n > 1, F.concat(F.encode(F.lit("second "), "UTF-8"), t)), "bzip2", F.col("object_id") % 9 + 1))
    lengths = F.transform(F.sequence(F.lit(1), F.ceil(F.octet_length(t) / 57).cast("int")), lambda _: F.lit(76))
    mime = F.when(n > 2, F.encode(F.concat(F.lit(_HEAD), base64_mime.wrap(t, lengths), F.lit("\r\n--")), "ISO-8859-1"))
    line = lambda c: F.coalesce(F.concat(B.literal("0A"), c), B.literal(""))
    return lineage.cut(rows.select("object_id", F.concat(t, line(F.col("gzip")), line(F.col("bzip2")), line(mime)).alias("content")))


_EMBEDDED = """b AS (SELECT doc_id AS object_id, 'document ' || doc_id || ': ' || coalesce(text, '') AS t FROM documents),
e AS (SELECT object_id, k::INT AS ordinal, CASE k WHEN 1 THEN 3 WHEN 2 THEN 10 ELSE 9 END AS format, CASE WHEN k = 2 THEN 'second ' || t ELSE t END AS text, CASE WHEN k = 1 THEN octet_length(encode(t)) + 1 END::BIGINT AS first_offset FROM b, range(1, 4) AS r(k) WHERE object_id % 4 >= k)"""


@query(f"WITH {_EMBEDDED} SELECT object_id, ordinal, format, TRUE AS accepted, text, first_offset FROM e")
def embedded_streams(spark, sf_dir):
    """None to three streams inside each object, in their order, with their content."""
    found = Engine(spark).precompress(_embedding(spark, sf_dir))
    ordinal = F.row_number().over(Window.partitionBy("object_id").orderBy("offset")).alias("ordinal")
    rows = found.select("object_id", ordinal, "format", "accepted", F.decode("content", "UTF-8").alias("text"), "offset")
    return rows.select("object_id", "ordinal", "format", "accepted", "text", F.when(F.col("ordinal") == 1, F.col("offset")).alias("first_offset"))


@query(f"WITH {_EMBEDDED} SELECT object_id, ordinal, format, text, first_offset FROM e WHERE ordinal = 1 AND format = 3")
def streams_of_one_format(spark, sf_dir):
    """The same objects where a switch leaves gzip on alone."""
    found = Engine(spark, ScanOptions(formats=("GZIP",))).precompress(_embedding(spark, sf_dir))
    return found.select("object_id", F.lit(1).alias("ordinal"), "format", F.decode("content", "UTF-8").alias("text"), F.col("offset").alias("first_offset"))


@query("SELECT doc_id AS object_id, TRUE AS verified, TRUE AS same, doc_id % 4 > 0 AS expanded FROM documents")
def rebuilt_objects(spark, sf_dir):
    """Objects written as a container and made again from it, held against the objects themselves."""
    own, engine = _embedding(spark, sf_dir), Engine(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/container-{uuid.uuid4().hex}"
    engine.write_container(own, path)
    back = engine.recompress(path).withColumnRenamed("content", "again")
    rows = own.join(back, "object_id").join(container.read_header(spark, path).select("object_id", "expanded"), "object_id")
    return rows.select("object_id", "verified", codecs.verified(F.col("content"), F.col("again")).alias("same"), "expanded")


@query("SELECT o_custkey AS object_id, max_by(o_orderkey % 9 + 1, o_orderkey)::INT AS level FROM orders GROUP BY o_custkey")
def last_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("offset"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("level"))
    return lineage.last_level(rows)


@query("SELECT doc_id AS object_id, CASE WHEN doc_id % 5 = 0 THEN 'recompress' ELSE 'precompress' END AS operation FROM documents")
def operations(spark, sf_dir):
    """A container's leading bytes stand before every fifth object."""
    head = F.when(F.col("object_id") % 5 == 0, B.literal("5043461A00000000")).otherwise(B.literal(""))
    return Engine(spark).operation(payloads(spark, sf_dir).withColumn("content", F.concat(head, "content")))


# --- dimensions and helpers -----------------------------------------------------------------------------------------


def _values(rows, names: str) -> str:
    say = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + f") AS t({names})"


@query(_values(registry.FORMATS, "id, name, switch_char, magic, supported"))
def format_table(spark, sf_dir):
    return registry.formats(spark)


@query(_values(registry.ERRORS, "code, message"))
def error_table(spark, sf_dir):
    return registry.error_codes(spark)


@query(_values([("builtin", n.lower(), s) for _, n, _, _, s in registry.FORMATS[1:]] + [(k, n.lower(), False) for k, names in registry.UNSUPPORTED.items() for n in names], "kind, name, supported"))
def capability_table(spark, sf_dir):
    return registry.capabilities(spark)


@query(f"WITH e AS ({_values(registry.ERRORS, 'code, message')}), o AS (SELECT o_orderkey, (o_orderkey % 30)::INT AS c FROM orders) SELECT o_orderkey, coalesce(message, 'Unknown error') AS message, CASE WHEN c IN (0, 2) THEN 0 ELSE 1 END AS exit_code, chr(10) || 'ERROR ' || c || ': ' || coalesce(message, 'Unknown error') AS text FROM o LEFT JOIN e ON code = c")
def error_messages(spark, sf_dir):
    code = (F.col("o_orderkey") % 30).cast("int")
    message = registry.error_message(code)
    return table(spark, sf_dir, "orders").select("o_orderkey", message.alias("message"), scalars.exit_code(code).alias("exit_code"), scalars.error_text(code, message).alias("text"))


_MS = "(o_orderkey * 40009 % 200000000)"


@query(f"""SELECT o_orderkey, 'Time: ' || CASE WHEN t < 1000 THEN t || ' millisecond(s)' WHEN t < 60000 THEN t // 1000 || ' second(s), ' || t % 1000 || ' millisecond(s)'
WHEN t < 3600000 THEN t // 60000 || ' minute(s), ' || t // 1000 % 60 || ' second(s)' WHEN t < 86400000 THEN t // 3600000 || ' hour(s), ' || t // 60000 % 60 || ' minute(s), ' || t // 1000 % 60 || ' second(s)'
ELSE t // 86400000 || ' day(s), ' || t // 3600000 % 24 || ' hour(s), ' || t // 60000 % 60 || ' minute(s)' END AS text FROM (SELECT o_orderkey, {_MS} AS t FROM orders)""")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.duration(F.expr("o_orderkey * 40009 % 200000000")).alias("text"))


_NAMES = "concat(p_brand, '/', p_name, CASE p_partkey % 3 WHEN 0 THEN '.pcf' WHEN 1 THEN '.txt' ELSE '' END)"


@query(f"""SELECT p_partkey, CASE WHEN f LIKE '%.pcf' THEN f || '_pcf.pcf' ELSE regexp_replace(f, '\\.[^./]*$', '') || '.pcf' END AS packed, f || '.pcf' AS kept, regexp_replace(f, '\\.pcf$', '') AS rebuilt
FROM (SELECT p_partkey, {_NAMES} AS f FROM part)""")
def output_names(spark, sf_dir):
    f = F.expr(_NAMES)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.output_name(f).alias("packed"), scalars.output_name(f, keep_extension=True).alias("kept"), scalars.output_name(f, rebuild=True).alias("rebuilt"))


@query("SELECT o_orderkey, CASE WHEN (o_orderkey * 99991) // 10 < 214748363 THEN (o_orderkey * 99991)::INT END AS number FROM orders")
def guarded_integers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.guarded_int(F.expr("cast(o_orderkey * 99991 as string)")).alias("number"))


@query("SELECT event_id, lower(event_type) LIKE 'c%' AS c_type, coalesce(props, '') NOT LIKE '%-' AS switched FROM events")
def switches(spark, sf_dir):
    props = F.coalesce("props", F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", scalars.begins_with(F.col("event_type"), "C").alias("c_type"), scalars.switch_value(props).alias("switched"))

