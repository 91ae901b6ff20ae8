"""Formats of BINARY content by its leading bytes: one native boolean expression for each, and the first that holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.functions.bytes import begins, byte, literal, part, size, uint_be, uint_le
from lodeseam.functions.registry import FORMATS, ID

MIME_BASE64 = "content-transfer-encoding: base64"


def is_base64(c: Column) -> Column:
    """A MIME header: bytes 1 to 4 in lower case as they stand, all 33 whatever their case."""
    lower = F.lower(F.decode(part(c, 0, len(MIME_BASE64)), "ISO-8859-1"))
    return (part(c, 1, 4) == literal("6F6E7465")) & (lower == MIME_BASE64)


def is_bzip2(c: Column) -> Column:
    return begins(c, "425A68") & F.coalesce(byte(c, 3).between(49, 57), F.lit(False))


def bzip2_level(c: Column) -> Column:
    """1 to 9, or -1."""
    return F.when(is_bzip2(c), byte(c, 3) - 48).otherwise(-1)


def _zlib(c: Column) -> Column:
    return (byte(c, 0).bitwiseAND(15) == 8) & (uint_be(c, 0, 2) % 31 == 0)


def is_zlib(c: Column) -> Column:
    """Method 8, a header that divides by 31, no preset dictionary."""
    return F.coalesce(_zlib(c) & (byte(c, 1).bitwiseAND(32) == 0), F.lit(False))


def is_zlib_stream(c: Column) -> Column:
    """A dictionary is allowed if its id is there; the window is one that the format has."""
    whole = (byte(c, 1).bitwiseAND(32) == 0) | (size(c) >= 6)
    return F.coalesce(_zlib(c) & (byte(c, 0) < 128) & whole, F.lit(False))


def is_deflate(c: Column) -> Column:
    """A deflate stream in a zlib wrapper with a window that the format has; dictionaries are allowed."""
    return F.coalesce(_zlib(c) & (byte(c, 0) < 128), F.lit(False))


def is_gzip(c: Column) -> Column:
    """Ten bytes, method 8, no reserved flags."""
    own = begins(c, "1F8B") & (byte(c, 2).bitwiseAND(15) == 8) & (byte(c, 3).bitwiseAND(224) == 0) & (size(c) >= 10)
    return F.coalesce(own, F.lit(False))


def may_be_gzip(c: Column) -> Column:
    return begins(c, "1F8B")


def is_zip(c: Column) -> Column:
    """A local header of 30 bytes or more with method 8, name and extra of at most 4096 bytes."""
    own = begins(c, "504B0304") & (size(c) >= 30) & (part(c, 8, 2) == literal("0800"))
    return F.coalesce(own & (uint_le(c, 26, 2) + uint_le(c, 28, 2) <= 4096), F.lit(False))


def is_png(c: Column) -> Column:
    return begins(c, "89504E470D0A1A0A")


def is_jpeg(c: Column) -> Column:
    return begins(c, "FFD8")


def is_gif(c: Column) -> Column:
    return part(c, 0, 6).isin(literal("474946383761"), literal("474946383961"))


def is_mp3(c: Column) -> Column:
    """A frame sync: eleven set bits."""
    return F.coalesce((byte(c, 0) == 255) & (byte(c, 1).bitwiseAND(224) == 224), F.lit(False))


def is_pdf(c: Column) -> Column:
    return begins(c, "255044462D")


def is_swf(c: Column) -> Column:
    """A compressed movie: a zlib header stands at 8."""
    return begins(c, "435753") & (size(c) >= 11) & is_zlib(part(c, 8, 2))


def is_wav(c: Column) -> Column:
    return begins(c, "52494646") & (part(c, 8, 4) == literal("57415645"))


def is_flac(c: Column) -> Column:
    return begins(c, "664C6143") & (size(c) >= 8) & F.coalesce(byte(c, 4).bitwiseAND(127) == 0, F.lit(False))


def is_container(c: Column) -> Column:
    """Whether content is one of our containers, so that it is to be rebuilt and not expanded."""
    return begins(c, "5043461A") & (size(c) >= 8)


#: Format, predicate, confidence; the first that holds wins, so weak ones stand last.
RULES = (
    ("PDF", is_pdf, 95), ("ZIP", is_zip, 90), ("GZIP", is_gzip, 90), ("PNG", is_png, 100), ("GIF", is_gif, 95),
    ("SWF", is_swf, 90), ("BASE64", is_base64, 95), ("BZIP2", is_bzip2, 90), ("WAV", is_wav, 95), ("FLAC", is_flac, 95),
    ("JPG", is_jpeg, 60), ("MP3", is_mp3, 30), ("ZLIB", is_zlib, 40), ("D_BRUTE", is_deflate, 20),
)


def detect(content: Column, enabled: Iterable[str] | None = None) -> Column:
    """(is_match, confidence, format) by the first rule among the enabled formats; they shape the plan, not a filter."""
    names = None if enabled is None else set(enabled)
    found = lambda sure, k: F.struct(F.lit(k > 0).alias("is_match"), F.lit(sure).alias("confidence"), F.lit(k).alias("format"))
    chosen = found(0, 0)
    for name, rule, confidence in reversed([r for r in RULES if names is None or r[0] in names]):
        chosen = F.when(rule(content), found(confidence, ID[name])).otherwise(chosen)
    return chosen


def switched(switch: str) -> list[str]:
    """Formats that a type switch leaves on: `t+xyz` only those of the letters, `t-xyz` all but those."""
    letters = set(switch[2:].lower())
    named = [(n, s) for _, n, s, *_ in FORMATS if s]
    if switch[:2] == "t+":
        return [n for n, s in named if s in letters]
    if switch[:2] == "t-":
        return [n for _, n, s, *_ in FORMATS[1:] if not s or s not in letters]
    raise ValueError("a type switch begins with t+ or t-")
