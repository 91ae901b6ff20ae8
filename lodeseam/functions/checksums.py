"""Checksums and statistics of bytes.

CRC-32 is a built-in.  The others read every byte, which expressions do a thousand times slower than the C code behind
Arrow batches, so they are Arrow functions; nothing but the content goes to Python, nothing but numbers comes back.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: CRC-16/ARC, the reflected polynomial A001, by byte.
_CRC16 = np.arange(256, dtype=np.int64)
for _ in range(8):
    _CRC16 = _CRC16 >> 1 ^ (_CRC16 & 1) * 0xA001
_CRC16_LIST = _CRC16.tolist()
#: Bytes of a lane where long contents are read in lanes, and the bytes above which they are.
_LANE, _LONG = 256, 1 << 14
# What a checksum becomes after _LANE zero bytes: one byte's table applied to itself.
_AFTER = np.arange(1 << 16, dtype=np.int64)
_AFTER = _AFTER >> 8 ^ _CRC16[_AFTER & 255]
for _ in range(_LANE.bit_length() - 1):
    _AFTER = _AFTER[_AFTER]
_AFTER = _AFTER.tolist()
#: Bytes with their bits in reverse order.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def crc32(content: Column) -> Column:
    """The checksum of zlib, gzip and PNG, as an unsigned BIGINT."""
    return F.crc32(content)


def _each(f, kind: str, out: pa.DataType, content: Column) -> Column:
    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in column.to_pylist()], out)

    return run(content)


def adler32(content: Column) -> Column:
    return _each(zlib.adler32, "bigint", pa.int64(), content)


def _crc16_of(data: bytes) -> int:
    """Byte by byte if short, else all lanes side by side; zeros before the first byte change nothing."""
    crc = 0
    if len(data) < _LONG:
        for b in data:
            crc = crc >> 8 ^ _CRC16_LIST[(crc ^ b) & 255]
        return crc
    whole = np.zeros(-(-len(data) // _LANE) * _LANE, np.uint8)
    whole[-len(data) :] = np.frombuffer(data, np.uint8)
    own = np.zeros(len(whole) // _LANE, np.int64)
    for column in np.ascontiguousarray(whole.reshape(-1, _LANE).T):
        own = own >> 8 ^ _CRC16[(own ^ column) & 255]
    for lane in own.tolist():
        crc = _AFTER[crc] ^ lane
    return crc


def _crc32_bzip2_of(data: bytes) -> int:
    """The same polynomial as zlib's with bits the other way round, of bytes and of the result."""
    return int(f"{zlib.crc32(data.translate(_REVERSED)):032b}"[::-1], 2)


def crc32_bzip2(content: Column) -> Column:
    """CRC-32/BZIP2, of a bzip2 block's bytes, as an unsigned BIGINT."""
    return _each(_crc32_bzip2_of, "bigint", pa.int64(), content)


def crc16(content: Column) -> Column:
    """CRC-16/ARC: the reflected polynomial A001 from 0."""
    return _each(_crc16_of, "bigint", pa.int64(), content)


def gzip_header_crc(header: Column) -> Column:
    """The low 16 bits of the CRC-32 of all header bytes before it."""
    return F.crc32(header).bitwiseAND(0xFFFF)


def _counts(data: bytes) -> list[dict]:
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return [{"byte": int(b), "n": int(n[b])} for b in np.flatnonzero(n)]


def byte_counts(content: Column) -> Column:
    """An array of (byte, n), for the byte values that content has."""
    out = pa.list_(pa.struct([("byte", pa.int32()), ("n", pa.int64())]))
    return _each(_counts, "array<struct<byte: int, n: bigint>>", out, content)


def histogram(objects: DataFrame, key: str = "object_id", content: str = "content") -> DataFrame:
    """(key, byte, n): how often each byte value stands in each object; at most 256 rows an object, without a shuffle."""
    return objects.select(key, byte_counts(F.col(content)).alias("_counts")).select(key, F.inline("_counts"))


def plausible(objects: DataFrame, most: float = 0.99, key: str = "object_id", content: str = "content") -> DataFrame:
    """(key, top_part, plausible): whether no byte value makes up more than `most` of an object; an empty one has no row."""
    counts = objects.select(key, F.octet_length(content).alias("_size"), byte_counts(F.col(content)).alias("_counts")).filter("_size > 0")
    found = counts.select(key, (F.array_max(F.transform("_counts", lambda c: c["n"])) / F.col("_size")).alias("top_part"))
    return found.withColumn("plausible", F.col("top_part") <= most)
