"""Integers and strings inside BINARY columns, as native expressions.  Offsets count from 0; past the end is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(content: Column, offset: int | Column, length: int | Column) -> Column:
    """The bytes [offset, offset + length)."""
    start = F.lit(offset) + 1 if isinstance(offset, int) else offset + 1
    return F.substring(content, start.cast("int"), (F.lit(length) if isinstance(length, int) else length).cast("int"))


def byte(content: Column, offset: int | Column) -> Column:
    return uint_be(content, offset, 1).cast("int")


def uint_be(content: Column, offset: int | Column, width: int) -> Column:
    """A big-endian unsigned integer of up to 7 bytes as BIGINT; null if it isn't all there."""
    own = part(content, offset, width)
    return F.when(F.octet_length(own) == width, F.conv(F.hex(own), 16, 10).cast("long"))


def uint_le(content: Column, offset: int | Column, width: int) -> Column:
    own = part(content, offset, width)
    return F.when(F.octet_length(own) == width, F.conv(_reversed_hex(own, width), 16, 10).cast("long"))


def _reversed_hex(own: Column, width: int) -> Column:
    digits = F.hex(own)
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))))


def literal(hex_digits: str) -> Column:
    return F.unhex(F.lit(hex_digits))


def begins(content: Column, hex_digits: str) -> Column:
    return F.startswith(content, literal(hex_digits))


def size(content: Column) -> Column:
    return F.octet_length(content)


def null_terminated(content: Column, offset: Column, most: int = 4096) -> Column:
    """The bytes from offset up to a zero byte, of at most `most`; null if there is none."""
    rest = part(content, offset, most)
    # Bytes as Latin-1 characters, one for one, so that a position counts bytes.
    at = F.locate("\0", F.decode(rest, "ISO-8859-1"))
    return F.when(at > 0, F.substring(rest, F.lit(1), at - 1))


def position(content: Column, hex_digits: str, start: int = 0) -> Column:
    """Where a pattern of bytes first stands at or after `start`, else -1."""
    text = F.decode(content, "ISO-8859-1")
    pattern = "".join(chr(b) for b in bytes.fromhex(hex_digits))
    return F.locate(pattern, text, start + 1) - 1
