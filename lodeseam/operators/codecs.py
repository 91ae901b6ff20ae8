"""Codecs on BINARY columns: Arrow batches in, structs with a row-level error out.  No row ever fails a job.

A decoder returns (content, crc32, consumed, error); `error` is null, or (code, message) with content null.  Output is
capped (`most`), so a small object that expands without end becomes an error of its row.
"""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that one object may expand to.
MOST = 1 << 28

_ERROR = pa.struct([("code", pa.int32()), ("message", pa.string())])
_OUT = pa.struct([("content", pa.binary()), ("crc32", pa.int64()), ("consumed", pa.int64()), ("error", _ERROR)])
DECODED = "struct<content: binary, crc32: bigint, consumed: bigint, error: struct<code: int, message: string>>"
#: Codes of broken streams; those of `registry.ERRORS` mean other things.
TRUNCATED, TOO_LARGE, CORRUPT = 101, 102, 103


class CodecError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _zlib_stream(wbits: int) -> Callable[[bytes, int], tuple[bytes, int]]:
    def decode(data: bytes, most: int) -> tuple[bytes, int]:
        own = zlib.decompressobj(wbits)
        out = own.decompress(data, most + 1)
        if len(out) > most:
            raise CodecError(TOO_LARGE, f"expands to over {most} bytes")
        if not own.eof:
            raise CodecError(TRUNCATED, "the stream has no end")
        return out, len(data) - len(own.unused_data)

    return decode


def _bzip2(data: bytes, most: int) -> tuple[bytes, int]:
    own = bz2.BZ2Decompressor()
    out = own.decompress(data, most + 1)
    if len(out) > most:
        raise CodecError(TOO_LARGE, f"expands to over {most} bytes")
    if not own.eof:
        raise CodecError(TRUNCATED, "the stream has no end")
    return out, len(data) - len(own.unused_data)


DECODERS = {"deflate": _zlib_stream(-15), "zlib": _zlib_stream(15), "gzip": _zlib_stream(31), "bzip2": _bzip2}


def _deflater(wbits: int) -> Callable[[bytes, int, int], bytes]:
    def encode(data: bytes, level: int, memory: int) -> bytes:
        own = zlib.compressobj(level if 1 <= level <= 9 else -1, zlib.DEFLATED, wbits, memory if 1 <= memory <= 9 else 8)
        return own.compress(data) + own.flush()

    return encode


ENCODERS = {
    "deflate": _deflater(-15),
    "zlib": _deflater(15),
    "gzip": _deflater(31),
    "bzip2": lambda data, level, memory: bz2.compress(data, level if 1 <= level <= 9 else 9),
}

#: Codecs that a user has registered: name to (decode(data, most) -> (content, consumed), encode(data, level, memory)).
_PLUGINS: dict[str, tuple[Callable, Callable]] = {}


def register(name: str, decode: Callable[[bytes, int], tuple[bytes, int]], encode: Callable[[bytes, int, int], bytes]) -> None:
    """Makes a codec known by name; its functions go to the workers with the plan that uses them."""
    _PLUGINS[name] = decode, encode


def registered() -> tuple[str, ...]:
    return tuple(sorted(_PLUGINS))


def _safely(decode: Callable, data: bytes | None, most: int) -> dict | None:
    if data is None:
        return None
    try:
        out, consumed = decode(data, most)
        return {"content": out, "crc32": zlib.crc32(out), "consumed": consumed, "error": None}
    except CodecError as e:
        return {"content": None, "crc32": None, "consumed": None, "error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # a codec's own errors are the row's
        return {"content": None, "crc32": None, "consumed": None, "error": {"code": CORRUPT, "message": f"{type(e).__name__}: {e}"}}


def expand(content: Column, codec: str, most: int = MOST) -> Column:
    """The content of a compressed stream, its checksum, how many bytes it took, or the error."""
    decode = _PLUGINS[codec][0] if codec in _PLUGINS else DECODERS[codec]

    @F.arrow_udf(DECODED)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([_safely(decode, x.as_py(), most) for x in column], _OUT)

    return run(content)


def pack(content: Column, codec: str, level: Column | int = 9, memory: Column | int = 8) -> Column:
    """A compressed stream; a level out of range means the codec's own."""
    encode = _PLUGINS[codec][1] if codec in _PLUGINS else ENCODERS[codec]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)

    @F.arrow_udf("binary")
    def run(column: pa.Array, level: pa.Array, memory: pa.Array) -> pa.Array:
        rows = zip(column.to_pylist(), level.to_pylist(), memory.to_pylist(), strict=True)
        return pa.array([None if x is None else encode(x, v or -1, m or 8) for x, v, m in rows], pa.binary())

    return run(content, as_column(level).cast("int"), as_column(memory).cast("int"))


def verified(original: Column, rebuilt: Column, crc: Column | int = 0) -> Column:
    """Whether bytes are the same and, unless 0 is expected, their checksum is."""
    expected = F.lit(crc).cast("long") if isinstance(crc, int) else crc
    same = (F.octet_length(original) == F.octet_length(rebuilt)) & (original == rebuilt)
    return F.coalesce(same & ((expected == 0) | (F.crc32(rebuilt) == expected)), F.lit(False))


def gains(original: Column, packed: Column) -> Column:
    """Whether compressing pays."""
    return F.coalesce(F.octet_length(packed) < F.octet_length(original), F.lit(False))


def _parameters(data: bytes, packed: bytes, wbits: int) -> tuple[int, int] | None:
    """The level and memory that give back exactly `packed`; the likeliest are tried first."""
    for memory in (8, 9):
        for level in (6, 9, 1, 5, 7, 8, 4, 3, 2):
            own = zlib.compressobj(level, zlib.DEFLATED, wbits, memory)
            if own.compress(data) + own.flush() == packed:
                return level, memory
    return None


_FOUND = pa.struct([("level", pa.int32()), ("memory", pa.int32())])


def parameters(content: Column, packed: Column) -> Column:
    """(level, memory) of a raw deflate stream that can be made again bit by bit, else null."""

    @F.arrow_udf("struct<level: int, memory: int>")
    def run(content: pa.Array, packed: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(content.to_pylist(), packed.to_pylist(), strict=True):
            found = None if x is None or y is None else _parameters(x, y, -15)
            out.append(None if found is None else {"level": found[0], "memory": found[1]})
        return pa.array(out, _FOUND)

    return run(content, packed)


# --- gzip headers of any length -------------------------------------------------------------------------------------

_GZIP = pa.struct(
    [
        ("flags", pa.int32()), ("mtime", pa.int64()), ("extra_flags", pa.int32()), ("os_type", pa.int32()), ("extra", pa.binary()),
        ("filename", pa.string()), ("comment", pa.string()), ("header_crc16", pa.int32()), ("header_length", pa.int32()), ("error", _ERROR),
    ]
)
GZIP_HEADER = (
    "struct<flags: int, mtime: bigint, extra_flags: int, os_type: int, extra: binary, filename: string, comment: string, "
    "header_crc16: int, header_length: int, error: struct<code: int, message: string>>"
)


def _gzip_header(data: bytes) -> dict:
    """RFC 1952; fields end within 4096 bytes, and a header checksum must hold."""

    def fail(message: str) -> dict:
        return {"error": {"code": TRUNCATED if "short" in message else CORRUPT, "message": message}}

    if len(data) < 10:
        return fail("short of ten bytes")
    if data[:2] != b"\x1f\x8b" or data[2] not in (0, 8) or data[3] & 0xE0:
        return fail("no gzip header")
    flags, at = data[3], 10
    out = {"flags": flags, "mtime": int.from_bytes(data[4:8], "little"), "extra_flags": data[8], "os_type": data[9]}
    if flags & 4:
        n = int.from_bytes(data[at : at + 2], "little")
        out["extra"], at = data[at + 2 : at + 2 + n], at + 2 + n
    for bit, name in ((8, "filename"), (16, "comment")):
        if flags & bit:
            end = data.find(b"\0", at)
            if end < 0:
                return fail(f"short of the end of {name}")
            out[name], at = data[at:end].decode("latin-1"), end + 1
    if flags & 2:
        crc = int.from_bytes(data[at : at + 2], "little")
        if at + 2 <= len(data) and crc != zlib.crc32(data[:at]) & 0xFFFF:
            return fail("the header's checksum doesn't hold")
        out["header_crc16"], at = crc, at + 2
    if at > min(len(data), 4096):
        return fail("short of the header's end")
    return out | {"header_length": at, "error": None}


def gzip_header(content: Column) -> Column:
    @F.arrow_udf(GZIP_HEADER)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _gzip_header(x) for x in column.to_pylist()], _GZIP)

    return run(content)
