"""Streams at any place: what is found, with which options, and that objects come back bit by bit."""

import base64
import bz2
import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodeseam.functions.registry import ID
from lodeseam.operators import lineage, streams
from lodeseam.plans.engine import Engine
from lodeseam.plans.options import ScanOptions

TEXT = b"pack my box with five dozen liquor jugs, said the zoo keeper. " * 30


def raw(data, level=6, memory=8, window=15):
    own = zlib.compressobj(level, zlib.DEFLATED, -window, memory)
    return own.compress(data) + own.flush()


def zip_member(data, name=b"a.txt", level=6):
    packed = raw(data, level)
    sizes = zlib.crc32(data).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"PK\3\4\x14\0\0\0\x08\0" + bytes(4) + sizes + len(name).to_bytes(2, "little") + b"\0\0" + name + packed


def png(data, cut, window=15):
    own = zlib.compressobj(9, zlib.DEFLATED, window)
    body = own.compress(data) + own.flush()
    chunk = lambda kind, x: len(x).to_bytes(4, "big") + kind + x + zlib.crc32(kind + x).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + b"".join(chunk(b"IDAT", body[k : k + cut]) for k in range(0, len(body), cut)) + chunk(b"IEND", b"")


def mime(data, width=76, tail=b"\r\n--boundary"):
    body = base64.b64encode(data)
    return b"Content-Transfer-Encoding: base64\r\n\r\n" + b"\r\n".join(body[k : k + width] for k in range(0, len(body), width)) + tail


def frame(spark, contents):
    return spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in contents], "object_id long, content binary")


def found(spark, content, **options):
    rows = streams.scan(frame(spark, [(0, content)]), ["object_id"], ScanOptions(**options)).collect()
    return [(r.offset, r.format, r.accepted, None if r.content is None else bytes(r.content)) for r in rows]


OBJECTS = {
    "gzip": (b"head" + gzip.compress(TEXT, mtime=0) + b"tail", [(4, "GZIP")]),
    "two": (b"a" + bz2.compress(TEXT, 3) + b"b" + gzip.compress(TEXT[:500], 9, mtime=7) + b"c", None),
    "zip": (zip_member(TEXT) + zip_member(TEXT[:99], b"b", 9) + b"PK\1\2rest", None),
    "mime": (b"Subject: x\r\n" + mime(TEXT) + b"\r\n" + mime(TEXT[:100], 60, b""), None),
    "png": (b"??" + png(TEXT, 20) + b"!!", [(2, "PNG")]),
    "small window": (png(TEXT[:400], 7, 9), [(0, "PNG")]),
    "pdf": (b"%PDF-1.4\n1 0 obj<</Filter/FlateDecode>>\nstream\r\n" + zlib.compress(TEXT, 9) + b"\nendstream\nendobj", [(40, "PDF")]),
    "swf": (b"xyz" + b"CWS\x09" + bytes(4) + zlib.compress(TEXT), [(3, "SWF")]),
}


def test_streams_stand_anywhere(spark):
    for name, (content, places) in OBJECTS.items():
        got = found(spark, content)
        assert got and all(accepted for *_, accepted, _ in got), name
        if places:
            assert [(o, f) for o, f, *_ in got] == [(o, ID[f]) for o, f in places], name
        assert len(got) == (2 if places is None else 1), name
        assert all(TEXT.startswith(c) for *_, c in got), name


def test_objects_come_back(spark, tmp_path):
    rng = random.Random(7)
    contents = [c for c, _ in OBJECTS.values()]
    for _ in range(40):
        parts = [rng.choice(contents + [rng.randbytes(rng.randrange(60)), b"", b"BZh91AY&SY", b"\x1f\x8b\x08\0broken", b"stream\nx", zlib.compress(TEXT)]) for _ in range(rng.randrange(1, 5))]
        contents.append(b"".join(parts)[: rng.choice((10**9, 700))])
    contents += [b"", None, TEXT, OBJECTS["two"][0]]
    rows = [(k % 9, c) for k, c in enumerate(contents)]  # ids repeat
    for n, options in enumerate((ScanOptions(), ScanOptions(intense=True, brute=True), ScanOptions(formats=("ZIP",)))):
        engine = Engine(spark, options)
        engine.write_container(frame(spark, rows).repartition(3), f"file://{tmp_path}/{n}")
        back = engine.recompress(f"file://{tmp_path}/{n}").collect()
        key = lambda r: (r[0], r[1] is not None, r[1] or b"")
        assert sorted(((r.object_id, None if r.content is None else bytes(r.content)) for r in back), key=key) == sorted(rows, key=key)
        assert all(r.verified for r in back)


def test_options_have_effect(spark):
    content = b"ab" + zlib.compress(TEXT) + b"cd" + raw(TEXT[:300]) + b"ef"
    assert found(spark, content) == []
    (at, kind, accepted, out), = found(spark, content, intense=True)
    assert (at, kind, accepted, out) == (2, ID["ZLIB"], True, TEXT)
    got = found(spark, content, brute=True)
    assert (4, ID["D_BRUTE"], True, TEXT) in got and TEXT[:300] in [c for *_, c in got]
    assert found(spark, content, intense=True, intense_limit=0) == []
    content = OBJECTS["two"][0]
    first, second = found(spark, content)
    assert found(spark, content, ignored=(first[0],)) == [second]
    assert [f for _, f, *_ in found(spark, content, formats=("GZIP",))] == [ID["GZIP"]]
    assert found(spark, content, inside=False) == []
    size = len(raw(TEXT[:500], 9))
    for least, want in ((size - 1, True), (size, False)):
        assert found(spark, gzip.compress(TEXT[:500], 9, mtime=7), min_identical=least)[0][2] is want


def test_broken_streams(spark):
    whole = gzip.compress(TEXT, mtime=0)
    rows = streams.scan(frame(spark, [(0, whole[:-30]), (1, b"x" + whole[:-30]), (2, b""), (3, None)]), ["object_id"]).collect()
    assert [(r.object_id, r.error.code, r.accepted) for r in rows] == [(0, 101, False)]
    assert found(spark, gzip.compress(bytes(10**6), mtime=0), max_output=1000)[0][2:] == (False, None)
    # What stands in a broken stream is found.
    assert [o for o, *_ in found(spark, b"\x1f\x8b\x08\0" + bytes(6) + b"\x07" + whole)][-1] == 11


def test_streams_in_streams_of_repeated_ids(spark):
    deep = b"x" + gzip.compress(b"yy" + bz2.compress(b"z" + zip_member(TEXT)), mtime=0)
    got = lineage.expand_all(frame(spark, [(5, deep), (5, deep + b"!"), (5, b"none")]), search=True)
    rows = got.groupBy("object_id", "depth", "format", "offset").agg(F.count("*").alias("n"), F.bool_and("accepted").alias("a")).orderBy("depth").collect()
    assert [tuple(r) for r in rows] == [(5, 1, ID["GZIP"], 1, 2, True), (5, 2, ID["BZIP2"], 2, 2, True), (5, 3, ID["ZIP"], 1, 2, True)]
    ids = {r.stream_id: r.parent_stream_id for r in got.collect()}
    assert len(ids) == 6 and sum(p in ids for p in ids.values()) == 4


@pytest.mark.parametrize("level", [1, 4, 6, 9])
def test_large_streams_are_made_again(spark, level):
    data = random.Random(level).randbytes(300_000) + TEXT * 400
    (_, _, accepted, out), = found(spark, b"q" + gzip.compress(data, level, mtime=0))
    assert accepted and out == data
