"""Streams at any place of an object: found, expanded and checked in one Arrow pass over its bytes.

A scan goes from left to right.  Where leading bytes of a format stand it tries to expand what follows; a stream that
has an end is taken and the scan goes on behind it, anything else is passed by (at byte 0, a format's broken stream is a
row with its error).  Of each stream the parameters are searched that give back its very bytes: `accepted`.

Taken are gzip, zip members, compressed swf, bzip2, MIME base64, IDAT data of png (as one stream, whatever its chunks),
flate streams of pdf, zlib at byte 0; with `intense` zlib anywhere, with `brute` raw deflate at any byte (of those only
streams that can be made again), both down to the depth of their limit.  `ignored` are offsets of objects where nothing
is tried.  A stream is accepted only if it has more than `min_identical` bytes.

What is left of an object when the bytes of its accepted streams are cut out is its residue; `spliced` puts both
together.  Null objects have no streams, like empty ones; their residue is null.
"""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeseam.functions.detect import detect
from lodeseam.functions.registry import ID
from lodeseam.operators import base64_mime, codecs
from lodeseam.plans.options import DEFAULTS, ScanOptions

#: Bytes that go into a codec at once, first and at most, and bytes of a batch that is handed on.
_FIRST, _MOST, _BATCH = 1 << 10, 1 << 20, 8 << 20

# Leading bytes of formats that hold streams.
_MARKS = {
    "GZIP": rb"\x1f\x8b\x08[\x00-\x1f]",
    "ZIP": rb"PK\x03\x04.{4}\x08\x00",
    "SWF": rb"CWS(?=.{5}[\x08\x18\x28\x38\x48\x58\x68\x78])",
    "BZIP2": rb"BZh[1-9](?:1AY&SY|\x17rE8P\x90)",
    "BASE64": rb"[Cc]onte(?i:nt-transfer-encoding: base64)",
    "PNG": rb"\x89PNG\r\n\x1a\n",
    "PDF": rb"(?<!end)stream\r?\n(?=[\x08\x18\x28\x38\x48\x58\x68\x78])",
    "ZLIB": rb"[\x08\x18\x28\x38\x48\x58\x68\x78](?=.)",
    "D_BRUTE": rb".(?=.)",
}

_FIELDS = [
    ("offset", pa.int64()), ("format", pa.int32()), ("header_length", pa.int32()), ("header", pa.binary()),
    ("segments", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
    ("compressed_size", pa.int64()), ("uncompressed_size", pa.int64()), ("level", pa.int32()), ("memory", pa.int32()),
    ("window_bits", pa.int32()), ("line_len", pa.list_(pa.int32())), ("ends", pa.bool_()), ("crc32", pa.int64()),
    ("accepted", pa.bool_()), ("error", codecs._ERROR), ("content", pa.binary()),
]
COLUMNS = [name for name, _ in _FIELDS]
STREAM = (
    "offset long, format int, header_length int, header binary, segments array<struct<offset: long, length: long>>, "
    "compressed_size long, uncompressed_size long, level int, memory int, window_bits int, line_len array<int>, ends boolean, "
    "crc32 long, accepted boolean, error struct<code: int, message: string>, content binary"
)


def _whole(own, data: bytes | memoryview, at: int, most: int) -> tuple[bytes, int]:
    """What a decompressor makes of data from `at` on, and where its stream ends; few bytes of what follows are read."""
    parts, size, step = [], 0, _FIRST
    while not own.eof:
        if at >= len(data):
            raise codecs.CodecError(codecs.TRUNCATED, "the stream has no end")
        block = data[at : at + step]
        at, step = at + len(block), min(2 * step, _MOST)
        parts.append(own.decompress(block, most + 1 - size))
        size += len(parts[-1])
        if size > most:
            raise codecs.CodecError(codecs.TOO_LARGE, f"expands to over {most} bytes")
    return b"".join(parts), at - len(own.unused_data)


def _deflated(data: bytes, level: int, memory: int, window: int) -> Iterator[bytes]:
    own = zlib.compressobj(level, zlib.DEFLATED, -window, memory)
    for at in range(0, len(data), _MOST >> 2):
        yield own.compress(data[at : at + (_MOST >> 2)])
    yield own.flush()


def _same(made: Iterable[bytes], packed: bytes) -> bool:
    """Whether the blocks are `packed`; the first difference ends it."""
    at = 0
    for block in made:
        if packed[at : at + len(block)] != block:
            return False
        at += len(block)
    return at == len(packed)


def _parameters(data: bytes, packed: bytes, window: int) -> tuple[int, int] | None:
    """Level and memory that give back exactly `packed`; the likeliest are tried first."""
    tries = ((level, memory) for memory in (8, 9) for level in (6, 9, 1, 5, 7, 8, 4, 3, 2))
    return next((t for t in tries if _same(_deflated(data, *t, window), packed)), None)


def _zlib_window(data: bytes | memoryview, at: int) -> int | None:
    """The window of a zlib header at `at`, if one stands there that needs no dictionary."""
    head = bytes(data[at : at + 2])
    good = len(head) == 2 and head[0] & 15 == 8 and head[0] < 128 and (head[0] << 8 | head[1]) % 31 == 0 and not head[1] & 32
    return max(9, (head[0] >> 4) + 8) if good else None


def _idat(data: bytes, at: int) -> list[tuple[int, int]]:
    """(offset, length) of the data of the IDAT chunks of a png at `at`."""
    out, at = [], at + 8
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if at + 12 + size > len(data) or (out and kind != b"IDAT"):
            break
        if kind == b"IDAT":
            out.append((at + 8, size))
        at += 12 + size
    return out


def _part(pieces: list[tuple[int, int]], skip: int, length: int) -> list[tuple[int, int]]:
    """Of pieces laid end to end the bytes [skip, skip + length)."""
    out = []
    for at, size in pieces:
        lo, hi = min(skip, size), min(skip + length, size)
        if hi > lo:
            out.append((at + lo, hi - lo))
        skip, length = skip - lo, length - (hi - lo)
    return out


class _Scan:
    """Streams of one object's bytes."""

    def __init__(self, data: bytes, options: ScanOptions, search: bool, depth: int):
        self.data, self.options, self.search, self.view = data, options, search, memoryview(data)
        self.pdf = data.find(b"%PDF-")
        names = [n for n in _MARKS if n in options.formats]
        anywhere = [n for n in names if n not in ("ZLIB", "D_BRUTE")]
        if options.intense and depth <= options.intense_limit and "ZLIB" in names:
            anywhere.append("ZLIB")
        self.brute = options.brute and depth <= options.brute_limit and "D_BRUTE" in names
        if self.brute:
            anywhere.append("D_BRUTE")
        either = lambda names: re.compile(b"|".join(b"(?P<%s>%s)" % (n.encode(), _MARKS[n]) for n in names) or rb"(?!)", re.DOTALL)
        self.first, self.pattern = either([n for n in names if n in anywhere or n == "ZLIB"]), either(anywhere)
        self.ignored = set(options.ignored) if depth == 1 else ()

    def streams(self) -> Iterator[dict]:
        at = 0
        while True:
            found = (self.first.match(self.data) if at == 0 else None) or (self.pattern.search(self.data, at) if self.options.inside else None)
            if found is None:
                return
            start, name = found.start(), found.lastgroup
            at = start + 1
            if start in self.ignored:
                continue
            made, error = self._tried(name, found)
            if made is None and self.brute and name != "D_BRUTE":
                again, _ = self._tried("D_BRUTE", found)
                made, name = (again, "D_BRUTE") if again else (None, name)
            if made is None and error is not None and start == 0 and name != "D_BRUTE":
                yield {"offset": 0, "format": ID[name], "accepted": False, "error": error}
            elif made is not None:
                end = made.pop("end")
                yield {"offset": start, "format": ID[name], "header": self.data[start : start + made["header_length"]], "error": None} | made
                at = max(at, end)

    def _tried(self, name: str, found: re.Match) -> tuple[dict | None, dict | None]:
        try:
            return getattr(self, f"_{name.lower()}")(found), None
        except Exception as e:  # a codec's own errors are the row's
            return None, {"code": e.code if isinstance(e, codecs.CodecError) else codecs.CORRUPT, "message": str(e)}

    def _row(self, start: int, header: int, pieces: list[tuple[int, int]], content: bytes, found: dict | None) -> dict:
        size = sum(n for _, n in pieces)
        return {
            "header_length": header, "segments": [{"offset": a, "length": n} for a, n in pieces], "compressed_size": size, "content": content,
            "uncompressed_size": len(content), "crc32": zlib.crc32(content), "end": sum(pieces[-1]) if pieces else start + header,
            "accepted": found is not None and size > self.options.min_identical, **(found or {}),
        }

    def _deflate(self, start: int, header: int, window: int = 15, pieces: list[tuple[int, int]] | None = None) -> dict:
        """Raw deflate data `header` bytes behind start, or in pieces from their byte 2 on."""
        if pieces is None:
            content, end = _whole(zlib.decompressobj(-15), self.view, start + header, self.options.max_output)
            pieces = [(start + header, end - start - header)]
        else:
            joined = b"".join(self.data[a : a + n] for a, n in pieces)
            content, end = _whole(zlib.decompressobj(-15), joined, 2, self.options.max_output)
            pieces = _part(pieces, 2, end - 2)
        found = None
        if self.search:
            best = _parameters(content, b"".join(self.data[a : a + n] for a, n in pieces), window)
            found = best and {"level": best[0], "memory": best[1], "window_bits": window}
        return self._row(start, header, pieces, content, found)

    def _gzip(self, found: re.Match) -> dict:
        head = codecs._gzip_header(self.data[found.start() : found.start() + 8192])
        if head["error"]:
            raise codecs.CodecError(head["error"]["code"], head["error"]["message"])
        return self._deflate(found.start(), head["header_length"])

    def _zip(self, found: re.Match) -> dict | None:
        at = found.start()
        lengths = [int.from_bytes(self.data[at + k : at + k + 2], "little") for k in (26, 28)]
        return None if sum(lengths) > 4096 else self._deflate(at, 30 + sum(lengths))

    def _swf(self, found: re.Match) -> dict | None:
        window = _zlib_window(self.data, found.start() + 8)
        return None if window is None else self._deflate(found.start(), 10, window)

    def _zlib(self, found: re.Match) -> dict | None:
        at = found.start()
        window = _zlib_window(self.data, at)
        if window is None:
            return None
        made = self._deflate(at, 2, window)
        sums = zlib.adler32(made["content"]).to_bytes(4, "big") == self.data[made["end"] : made["end"] + 4]
        return made if at == 0 or sums else None

    def _d_brute(self, found: re.Match) -> dict | None:
        at = found.start()
        if self.data[at] >> 1 & 3 == 3:
            return None
        content, end = _whole(zlib.decompressobj(-15), self.view, at, self.options.max_output)
        if end - at <= self.options.min_identical or (best := _parameters(content, self.data[at:end], 15)) is None:
            return None
        return self._row(at, 0, [(at, end - at)], content, {"level": best[0], "memory": best[1], "window_bits": 15})

    def _pdf(self, found: re.Match) -> dict | None:
        window = _zlib_window(self.data, found.end())
        if window is None or not 0 <= self.pdf < found.start():
            return None
        return self._deflate(found.start(), found.end() + 2 - found.start(), window)

    def _png(self, found: re.Match) -> dict | None:
        pieces = _idat(self.data, found.start())
        window = _zlib_window(b"".join(self.data[a : a + min(n, 2)] for a, n in pieces), 0)
        return None if window is None else self._deflate(found.start(), pieces[0][0] + 2 - found.start(), window, pieces)

    def _bzip2(self, found: re.Match) -> dict:
        at = found.start()
        content, end = _whole(bz2.BZ2Decompressor(), self.view, at, self.options.max_output)
        level = self.data[at + 3] - 48
        same = self.search and bz2.compress(content, level) == self.data[at:end]
        return self._row(at, 0, [(at, end - at)], content, {"level": level} if same else None)

    def _base64(self, found: re.Match) -> dict | None:
        start, body = found.start(), self.data.find(b"\r\n\r\n", found.end())
        if body < 0:
            return None
        while self.data.startswith(b"\r\n", body):
            body += 2
        end = _BODY.match(self.data, body).end()
        read = base64_mime._body(self.data[body:end], self.options.min_identical)
        if end == body or read["decoded"] is None:
            return None
        found = {"line_len": read["line_len"], "ends": read["ends"]} if read["accepted"] else None
        return self._row(start, body - start, [(body, end - body)], read["decoded"], found)


_BODY = re.compile(rb"(?:[A-Za-z0-9+/]+\r\n)*[A-Za-z0-9+/]*={0,2}(?:\r\n)?")


def _residue(data: bytes, pieces: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, n in sorted(pieces):
        out.append(data[at:a])
        at = a + n
    return b"".join([*out, data[at:]])


def scan(objects: DataFrame, keep: list[str], options: ScanOptions = DEFAULTS, search: bool = True, residue: bool = False, depth: int = 1) -> DataFrame:
    """A row a stream of objects (content and the columns to keep), in order of their offsets.

    search: whether parameters are looked for.  residue: adds a row for each object, without offset and format, whose
    content is what its accepted streams leave, compressed_size and crc32 those of the whole object.
    """
    fields = {f.name: f for f in objects.schema.fields}
    schema = StructType([fields[k] for k in keep] + StructType.fromDDL(STREAM).fields)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([batch.schema.field(k) for k in keep] + [pa.field(n, t) for n, t in _FIELDS])
            rows, held = [], 0
            for i in range(batch.num_rows):
                data, pieces = batch.column("content")[i].as_py(), []
                about = {k: batch.column(k)[i].as_py() for k in keep}
                if data is None:
                    if residue:
                        rows.append(about | {"accepted": False})
                    continue
                for row in _Scan(data, options, search, depth).streams():
                    if row["accepted"]:
                        pieces += [(s["offset"], s["length"]) for s in row["segments"]]
                    rows.append(about | row)
                    held += len(row.get("content") or b"")
                    if held > _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, out)
                        rows, held = [], 0
                if residue:
                    left = _residue(data, pieces)
                    rows.append(about | {"compressed_size": len(data), "crc32": zlib.crc32(data), "accepted": False, "content": left})
                    held += len(left)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, out)

    if not options.inside and not residue:
        objects = objects.filter(detect(F.col("content"), [f for f in options.formats if f in _MARKS])["format"] > 0)
    return objects.select(*keep, "content").mapInArrow(of, schema)


def repacked(rows: DataFrame) -> Column:
    """The very bytes of accepted streams again, from their content and parameters."""
    bzip2, base64 = ID["BZIP2"], ID["BASE64"]

    @F.arrow_udf("binary")
    def run(format: pa.Array, content: pa.Array, level: pa.Array, memory: pa.Array, window: pa.Array, lines: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for row in zip(format, content, level, memory, window, lines, ends, strict=True):
            kind, data, level_, memory_, window_, lines_, ends_ = (x.as_py() for x in row)
            if data is None or kind is None:
                out.append(None)
            elif kind == bzip2:
                out.append(bz2.compress(data, level_))
            elif kind == base64:
                out.append(base64_mime._wrapped(data, lines_).encode() + (b"\r\n" if ends_ else b""))
            else:
                out.append(b"".join(_deflated(data, level_, memory_, window_)))
        return pa.array(out, pa.binary())

    return run(*(rows[c] for c in ("format", "content", "level", "memory", "window_bits", "line_len", "ends")))


def spliced(residue: Column, streams: Column) -> Column:
    """An object's bytes from its residue and the array (segments, packed) of its accepted streams."""

    @F.arrow_udf("binary")
    def run(residue: pa.Array, streams: pa.Array) -> pa.Array:
        out = []
        for left, own in zip(residue, streams, strict=True):
            left, places = left.as_py(), []
            for s in own.as_py() or []:
                at = 0
                for piece in s["segments"]:
                    places.append((piece["offset"], s["packed"][at : at + piece["length"]]))
                    at += piece["length"]
            made, at, size = [], 0, 0
            for offset, data in sorted(places):
                made += [left[at : at + offset - size], data]
                at, size = at + offset - size, offset + len(data)
            out.append(None if left is None else b"".join([*made, left[at:]]))
        return pa.array(out, pa.binary())

    return run(residue, streams)
