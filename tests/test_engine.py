"""Predicates at their edges, codecs on broken input, walkers, containers, options."""

import bz2
import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodeseam.functions import bytes as B
from lodeseam.functions import checksums, detect, headers, registry, scalars
from lodeseam.operators import base64_mime, codecs, lineage
from lodeseam.operators.deflate_walk import DeflateBlocks, analyse, blocks
from lodeseam.operators.walkers import Bzip2Blocks, EmbeddedHeaders, FlacBlocks, GifRecords, RiffChunks
from lodeseam.plans.engine import Engine
from lodeseam.plans.options import COMMAND_DEPTH, ScanOptions, UsageError, parse
from lodeseam.sources import container, objects
from lodeseam.sources.objects import callback_source

TEXT = b"the quick brown fox jumps over the lazy dog. " * 40


def raw(data, level=6, memory=8):
    own = zlib.compressobj(level, zlib.DEFLATED, -15, memory)
    return own.compress(data) + own.flush()


def frame(spark, contents):
    return spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(contents)], "object_id long, content binary")


def column(spark, contents, expression):
    return [r[0] for r in frame(spark, contents).select("object_id", expression.alias("x")).orderBy("object_id").select("x").collect()]


FULL = {
    "PDF": b"%PDF-1.4\n", "ZIP": bytes.fromhex("504B0304140000000800000000000000000064000000E803000005000300"), "PNG": b"\x89PNG\r\n\x1a\n",
    "GZIP": gzip.compress(TEXT, mtime=0), "GIF": b"GIF89a", "SWF": b"CWS\x0a\0\0\0\0\x78\x9c\0", "BZIP2": bz2.compress(TEXT),
    "WAV": b"RIFF\0\0\0\0WAVE", "FLAC": b"fLaC\0\0\0\x22", "JPG": b"\xff\xd8", "MP3": b"\xff\xfb", "ZLIB": zlib.compress(TEXT),
    "BASE64": b"Content-Transfer-Encoding: base64\r\n\r\nQUJD\r\n",
}


def test_each_format_is_found_and_cut_ones_are_not_an_error(spark):
    names = sorted(FULL)
    found = column(spark, [FULL[n] for n in names], detect.detect(F.col("content"))["format"])
    assert [registry.FORMATS[k][1] for k in found] == names
    prefixes = [FULL[n][:k] for n in names for k in range(31)] + [None]
    kinds = column(spark, prefixes, detect.detect(F.col("content"))["format"])
    assert all(0 <= k <= 15 for k in kinds) and kinds[-1] == 0
    for n in names:
        short = column(spark, [FULL[n][:1], b""], {r[0]: r[1] for r in detect.RULES}[n](F.col("content")))
        assert not any(short)


def test_rules_with_arithmetic(spark):
    pairs = [bytes((a, b)) for a in (0x08, 0x18, 0x78, 0x79, 0x88) for b in range(256)]
    for rule, dictionary in ((detect.is_zlib, False), (detect.is_deflate, True)):
        want = [p[0] & 15 == 8 and (p[0] * 256 + p[1]) % 31 == 0 and (dictionary or not p[1] & 32) and (not dictionary or p[0] < 128) for p in pairs]
        assert column(spark, pairs, rule(F.col("content"))) == want


def test_type_switches():
    assert detect.switched("t+pn") == ["PDF", "PNG"]
    left = detect.switched("t-png")
    assert "PDF" not in left and "GZIP" not in left and "ZIP" in left and "WAV" in left


def test_levels_and_names(spark):
    for level in range(1, 10):
        packed = zlib.compress(TEXT, level)
        assert column(spark, [packed], headers.zlib_header(F.col("content"))["level"])[0] == {1: 1, 2: 3, 3: 3, 4: 3, 5: 3, 6: 6}.get(level, 9)
        assert column(spark, [bz2.compress(TEXT, level)], headers.bzip2_header(F.col("content"))["block_size"])[0] == level * 100000
    assert column(spark, [b"BZh0", b"BZh", b"BZh9"], detect.bzip2_level(F.col("content"))) == [-1, -1, 9]


def test_flac_and_wav(spark):
    info = bytes.fromhex("03E81000000000000000" + "0AC442F0000F4240" + "000102030405060708090A0B0C0D0E0F")
    flac = b"fLaC\0\0\0\x22" + info + b"\x81\0\0\x04abcd"
    f = column(spark, [flac], headers.flac_streaminfo(F.col("content")))[0]
    assert (f.sample_rate, f.channels, f.bits_per_sample, f.total_samples, bytes(f.md5)) == (44100, 2, 16, 1000000, bytes(range(16)))
    found = frame(spark, [flac, b"fLaC"]).lateralJoin(FlacBlocks(F.col("content").outer())).orderBy("object_id", "idx").collect()
    assert [(r.block_type, r.size, r.last) for r in found] == [(0, 34, False), (1, 4, True)]
    wav = b"RIFF\x30\0\0\0WAVE" + b"LIST\x03\0\0\0abc\0" + b"data\x04\0\0\0wxyz"
    found = frame(spark, [wav, b"RIFF"]).lateralJoin(RiffChunks(F.col("content").outer())).orderBy("idx").collect()
    assert [(r.tag, r.offset, r.size) for r in found] == [("LIST", 20, 3), ("data", 32, 4)]


def test_gif_and_bzip2_blocks(spark):
    gif = b"GIF89a" + b"\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + b"\0" * 9 + b"\x02\x02\x4c\x01\0" + b"\x3b"
    found = frame(spark, [gif, gif[:9]]).lateralJoin(GifRecords(F.col("content").outer())).orderBy("object_id", "idx").collect()
    assert [r.kind for r in found] == ["screen", "colors", "extension", "image", "end"]
    data = random.Random(1).randbytes(250_000)
    found = frame(spark, [bz2.compress(data, 1)]).lateralJoin(Bzip2Blocks(F.col("content").outer())).collect()
    assert len(found) == 3
    packed = bz2.compress(data, 1)
    text = f"{int.from_bytes(packed, 'big'):0{8 * len(packed)}b}"
    at = [k for k in range(len(text) - 47) if text.startswith(f"{0x314159265359:048b}", k)]
    assert [r.bit_offset for r in found] == at and sum(r.bits for r in found) == text.rfind(f"{0x177245385090:048b}") - at[0]


def test_checksums(spark):
    contents = [b"", b"a", TEXT, bytes(range(256)) * 300, None]
    assert column(spark, contents, checksums.adler32(F.col("content"))) == [None if c is None else zlib.adler32(c) for c in contents]
    assert column(spark, [b"123456789"], checksums.crc16(F.col("content"))) == [0xBB3D]
    assert column(spark, [b"123456789", b""], checksums.crc32_bzip2(F.col("content"))) == [0xFC891918, 0]
    for n in (16384, 16385, 70_001):  # in lanes, as byte by byte
        data, crc = random.Random(n).randbytes(n), 0
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (crc & 1) * 0xA001
        assert checksums._crc16_of(data) == crc
    assert column(spark, contents[:4], checksums.crc32(F.col("content"))) == [zlib.crc32(c) for c in contents[:4]]


def test_round_trips_and_errors_stay_in_their_rows(spark):
    data = [b"", TEXT, random.Random(2).randbytes(5000), None]
    for codec in codecs.DECODERS:
        for level in (1, 6, 9, 99):
            out = column(spark, data, codecs.expand(codecs.pack(F.col("content"), codec, level), codec))
            assert [None if o is None else bytes(o.content) for o in out] == data
    packed = zlib.compress(TEXT)
    broken = [packed[:k] for k in range(31)] + [bytes([*packed[:k], packed[k] ^ 1 << (k % 8), *packed[k + 1 :]]) for k in range(len(packed))]
    for out in column(spark, broken, codecs.expand(F.col("content"), "zlib")):
        assert (out.content is None) == (out.error is not None)
    bomb = column(spark, [zlib.compress(bytes(1_000_000))], codecs.expand(F.col("content"), "zlib", most=1000))[0]
    assert bomb.error.code == codecs.TOO_LARGE


def test_deflate_walk(spark):
    mixed = zlib.compressobj(6, zlib.DEFLATED, -15)
    parts = [mixed.compress(TEXT), mixed.flush(zlib.Z_FULL_FLUSH), mixed.compress(b"ab"), mixed.flush()]
    streams = [raw(TEXT, 0 or 1), raw(random.Random(3).randbytes(70000), 9), b"".join(parts), raw(b"")]
    found = column(spark, streams, analyse(F.col("content")))
    assert [f.output_bytes for f in found] == [len(zlib.decompress(s, -15)) for s in streams] and not any(f.error for f in found)
    assert found[1].stored > 0 and found[0].dynamic + found[0].fixed > 0
    for junk in (b"\0" * 11, b"\xff" * 40, b"", b"\x07", *(streams[0][:k] for k in range(0, 60, 7))):
        with pytest.raises((EOFError, ValueError)):
            list(blocks(junk))
    rows = frame(spark, [streams[2]]).lateralJoin(DeflateBlocks(F.col("content").outer())).orderBy("idx").collect()
    assert [r.last for r in rows][-1] and sum(r.output_bytes for r in rows) == len(TEXT) + 2


def test_gzip_headers_with_every_flag(spark):
    extra, name, comment = b"ab\x01\0x", "name", "a comment"
    head = b"\x1f\x8b\x08" + bytes([1 | 4 | 8 | 16 | 2]) + b"\x01\0\0\0\x04\x03" + len(extra).to_bytes(2, "little") + extra + b"name\0a comment\0"
    whole = head + (zlib.crc32(head) & 0xFFFF).to_bytes(2, "little")
    g, bad, short, reserved = column(spark, [whole + raw(TEXT), whole[:-1] + b"\xee" + raw(TEXT), whole[:20], b"\x1f\x8b\x08\xe0" + bytes(6)], codecs.gzip_header(F.col("content")))
    assert (bytes(g.extra), g.filename, g.comment, g.header_length, g.error) == (extra, name, comment, len(whole), None)
    assert bad.error and short.error and reserved.error


def test_base64_lines(spark):
    import base64

    body = base64.b64encode(TEXT).decode()
    lines = lambda n: "\r\n".join(body[k : k + n] for k in range(0, len(body), n))
    head = "CoNTent-Transfer-Encoding: base64\r\n\r\n"
    irregular = "\r\n".join((body[:8], body[8:80], body[80:84], body[84:284], body[284:484], *(body[k : k + 200] for k in range(484, len(body), 200))))
    bodies = [lines(76) + "\r\n", lines(40), irregular, lines(300), lines(76)[:-1] + "*", body[:75] + "-" + body[76:]]
    good = [("Content-Transfer-Encoding: base64\r\n\r\n" + b).encode() for b in bodies]
    rows = {r.object_id: r for r in base64_mime.decode(frame(spark, [*good, (head + lines(76)).encode()])).collect()}
    assert [rows[k].accepted for k in range(6)] == [True, True, True, False, False, False]
    assert 6 not in rows  # its first letters aren't as they must be
    assert [rows[k].line_case for k in range(3)] == [1, 0, 2] and bytes(rows[0].decoded) == TEXT
    again = base64_mime.rebuild(base64_mime.decode(frame(spark, good)).filter("accepted")).collect()
    assert {r.object_id: bytes(r.content) for r in again} == {k: good[k] for k in range(3)}


def test_common_prefix(spark):
    a, b = frame(spark, [b"same", b"xbc", b"ab", b""]), frame(spark, [b"same", b"abc", b"abcd", b"q"])
    assert {r.object_id: r.identical for r in base64_mime.compare(a, b, "object_id").collect()} == {0: 4, 1: 0, 2: 2, 3: 0}


def test_containers(spark, tmp_path):
    contents = [zlib.compress(TEXT, 3), gzip.compress(TEXT, 9, mtime=1), bz2.compress(TEXT, 4), b"plain", raw(TEXT), b"PK\3\4" + bytes(4) + b"\x08\0" + bytes(16) + b"\x01\0\0\0" + b"n" + raw(TEXT, 7) + b"tail"]
    own = frame(spark, contents)
    engine = Engine(spark)
    engine.write_container(own, f"file://{tmp_path}/c")
    back = {r.object_id: r for r in engine.recompress(f"file://{tmp_path}/c").collect()}
    assert {k: bytes(r.content) for k, r in back.items()} == dict(enumerate(contents)) and all(r.verified for r in back.values())
    assert container.read_header(spark, f"file://{tmp_path}/c").filter("expanded").count() == 4
    spark.range(1).write.parquet(f"file://{tmp_path}/d/manifest")
    with pytest.raises(container.ContainerError):
        container.read_header(spark, f"file://{tmp_path}/d")


def test_depth_limits(spark):
    content = TEXT
    for k in range(4):
        content = gzip.compress(content, mtime=k)
    for limit, want in ((1, 1), (2, 2), (None, 4)):
        found = lineage.expand_all(frame(spark, [content]), ScanOptions(max_depth=limit))
        assert found.filter("error IS NULL").count() == want


def test_embedded_and_greedy(spark):
    data = b"x" * 7 + gzip.compress(TEXT, mtime=0) + b"%PDF-1"
    found = frame(spark, [data]).lateralJoin(EmbeddedHeaders(F.col("content").outer())).orderBy("offset").collect()
    assert (found[0].offset, found[0].format) == (7, 3) and found[-1].format == 1
    inside = lineage.candidates(frame(spark, [data, FULL["PNG"]])).collect()
    assert {(r.object_id, r.offset, r.format) for r in inside} >= {(0, 7, 3), (1, 0, 4)}
    rows = spark.createDataFrame([(0, 0, 5), (0, 3, 9), (0, 5, 2), (0, 5, 4), (0, 20, 0), (1, 2, 2)], "object_id long, offset long, length long")
    assert {tuple(r) for r in lineage.greedy(rows).collect()} == {(0, 0, 5), (0, 5, 4), (1, 2, 2)}


def test_callbacks(spark):
    def opener(data):
        def start():
            import io

            return io.BytesIO(data).read

        return start

    spark.dataSource.register(callback_source("mem", [opener(b"abc"), opener(TEXT * 100), lambda: None]))
    found = {r.object_id: r.content for r in spark.read.format("mem").load().collect()}
    assert bytes(found[0]) == b"abc" and len(found[1]) == len(TEXT) * 100 and found[2] is None
    rows = objects.checked(spark.read.format("mem").load(), most=100).collect()
    assert sorted((r.object_id, None if r.error is None else r.error.code) for r in rows) == [(0, None), (1, 21), (2, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abcd")
    got = objects.read_objects(spark, f"file://{tmp_path}").collect()
    assert [(bytes(r.content), r.length) for r in got] == [(b"abcd", 4)]
    assert objects.object_size(spark, f"file://{tmp_path}/a.bin") == 4 and objects.object_size(spark, f"file://{tmp_path}/b") == -1
    from lodeseam.streaming.arrivals import counts, read_arrivals

    query = counts(read_arrivals(spark, f"file://{tmp_path}")).writeStream.format("memory").queryName("arrived").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM arrived").first()[0] == 1


def test_plugins(spark):
    codecs.register("flip", lambda data, most: (data[::-1], len(data)), lambda data, level, memory: data[::-1])
    assert column(spark, [b"abc"], codecs.expand(codecs.pack(F.col("content"), "flip"), "flip")["content"]) == [bytearray(b"abc")]
    rows = registry.capabilities(spark, codecs.registered()).filter("name = 'flip'").collect()
    assert [r.supported for r in rows] == [True]


def test_command_line():
    own = parse(["-t+pz", "-d3", "-s8", "-oout.pcf", "in.bin"])
    assert (own.operation, own.source, own.target, own.options.formats, own.options.max_depth, own.options.min_identical) == ("precompress", "in.bin", "out.pcf", ("PDF", "ZIP"), 3, 8)
    assert parse(["x"]).options.max_depth == COMMAND_DEPTH and parse(["-r", "x"]).operation == "recompress" and parse(["-intense5", "x"]).options.intense_limit == 5
    for words, code in ((["a", "b"], 12), (["-ox", "-oy"], 11), (["-o"], 10), (["-d1", "-d2"], 8), (["-s1", "-s2"], 9), (["-what"], 1)):
        with pytest.raises(UsageError) as e:
            parse(words)
        assert e.value.code == code


def test_scalars(spark):
    numbers = ["12", "x1", "", "2147483640", "2147483700", "99999999999"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r[0] for r in df.select(scalars.guarded_int(F.col("n"))).collect()] == [12, None, None, None, None, None]
    c = b"ab\0cd"
    assert column(spark, [c, b"abc"], B.null_terminated(F.col("content"), F.lit(0))) == [bytearray(b"ab"), None]
