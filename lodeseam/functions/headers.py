"""Headers at fixed offsets as structs of native expressions, and the arithmetic on their fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.functions.bytes import byte, literal, part, position, size, uint_be, uint_le
from lodeseam.functions.detect import bzip2_level, is_flac, is_wav
from lodeseam.functions.registry import block_type, level_name


def _struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


# --- gzip -----------------------------------------------------------------------------------------------------------


def gzip_level(extra_flags: Column) -> Column:
    """4 means fastest, 2 best; where both are set, 4 counts."""
    return F.when(extra_flags.bitwiseAND(4) != 0, 1).when(extra_flags.bitwiseAND(2) != 0, 9).otherwise(6)


def gzip_fixed(c: Column) -> Column:
    """The ten bytes that every gzip header has; mtime 0 stands for unknown."""
    mtime = uint_le(c, 4, 4)
    return _struct(
        method=byte(c, 2), flags=byte(c, 3), mtime=mtime, modified=F.when(mtime > 0, F.timestamp_seconds(mtime)),
        extra_flags=byte(c, 8), os_type=byte(c, 9), level=gzip_level(byte(c, 8)),
    )


def gzip_header_bytes(flags: Column, mtime: Column, extra_flags: Column, os_type: Column, extra: Column, name: Column, comment: Column, crc16: Column) -> Column:
    """A gzip header put together again: what of extra, name, comment and crc16 the flags announce."""
    low = lambda v, n: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(n))))
    on = lambda bit, v: F.when(flags.bitwiseAND(bit) != 0, v).otherwise(literal(""))
    return F.concat(
        literal("1F8B08"), low(flags, 1), low(mtime, 4), low(extra_flags, 1), low(os_type, 1),
        on(4, F.concat(low(F.octet_length(extra), 2), extra)),
        on(8, F.concat(F.encode(name, "ISO-8859-1"), literal("00"))),
        on(16, F.concat(F.encode(comment, "ISO-8859-1"), literal("00"))),
        on(2, low(crc16, 2)),
    )


# --- zlib and deflate -----------------------------------------------------------------------------------------------


def zlib_level(flg: Column) -> Column:
    """1, 3, 6 or 9 for the two level bits."""
    return F.element_at(F.array(*map(F.lit, (1, 3, 6, 9))), F.shiftright(flg, 6) + 1)


def zlib_header(c: Column) -> Column:
    cmf, flg = byte(c, 0), byte(c, 1)
    has = flg.bitwiseAND(32) != 0
    return _struct(
        cmf=cmf, flg=flg, method=cmf.bitwiseAND(15), window_bits=F.shiftright(cmf, 4) + 8, level=zlib_level(flg),
        has_dictionary=has, dictionary_id=F.when(has, uint_be(c, 2, 4)),
        header_length=F.when(has, 6).otherwise(2), compressed_size=size(c) - F.when(has, 6).otherwise(2),
    )


def zlib_header_bytes(c: Column) -> Column:
    """The header as it stands, with the dictionary's id where there is one: no bit of it is made anew."""
    return part(c, 0, F.when(byte(c, 1).bitwiseAND(32) != 0, 6).otherwise(2))


def deflate_level(n_stored: Column, n_fixed: Column, n_dynamic: Column, lit_codes: Column, dist_codes: Column) -> Column:
    """A guess at the level from a stream's blocks."""
    blocks = n_stored + n_fixed + n_dynamic
    large = (lit_codes > 280) | (dist_codes > 28)
    return (
        F.when(n_stored * 2 > blocks, 1).when(n_fixed > n_dynamic, 3).when(n_dynamic > 0, F.when(large, 7).otherwise(5)).otherwise(6)
    )


def deflate_report(n_stored: Column, n_fixed: Column, n_dynamic: Column, level: Column) -> Column:
    names = [block_type(F.lit(k)) for k in range(3)]
    return F.format_string("%d blocks: %d %s, %d %s, %d %s; level %d (%s)", n_stored + n_fixed + n_dynamic, n_stored, names[0], n_fixed, names[1], n_dynamic, names[2], level, level_name(level))


# --- bzip2 ----------------------------------------------------------------------------------------------------------


def bzip2_header(c: Column) -> Column:
    level = bzip2_level(c)
    known = level > 0
    return _struct(
        block_size_indicator=F.when(known, byte(c, 3)), block_size=F.when(known, level * 100000),
        level=F.when(known, level).otherwise(6), description=F.when(known, F.format_string("%d kB", level * 100)),
        randomized=F.lit(False),
    )


def bzip2_header_bytes(level: Column) -> Column:
    return F.concat(literal("425A68"), F.encode(level.cast("string"), "ISO-8859-1"))


# --- zip, swf -------------------------------------------------------------------------------------------------------


def zip_header(c: Column) -> Column:
    name, extra = uint_le(c, 26, 2).cast("int"), uint_le(c, 28, 2).cast("int")
    return _struct(
        method=uint_le(c, 8, 2).cast("int"), crc32=uint_le(c, 14, 4), compressed_size=uint_le(c, 18, 4),
        uncompressed_size=uint_le(c, 22, 4), name_length=name, extra_length=extra, header_length=30 + name + extra,
    )


def stream_offset(c: Column, format_name: str) -> Column:
    """Where the deflate stream of a format begins, as far as it is at a fixed place."""
    return {"ZIP": zip_header(c)["header_length"], "SWF": F.lit(10), "ZLIB": F.lit(2), "BZIP2": F.lit(0)}[format_name]


# --- media ----------------------------------------------------------------------------------------------------------


def flac_streaminfo(c: Column) -> Column:
    """The first metadata block of a FLAC file, after its four-byte header."""
    b = lambda k: byte(c, 8 + k)
    rate = F.shiftright(uint_be(c, 18, 3), 4).cast("int")
    bps = F.shiftleft(b(12).bitwiseAND(1), 4).bitwiseOR(F.shiftright(b(13), 4)) + 1
    total = F.shiftleft(b(13).bitwiseAND(15).cast("long"), 32).bitwiseOR(uint_be(c, 22, 4))
    low, most = uint_be(c, 8, 2).cast("int"), uint_be(c, 10, 2).cast("int")
    found = _struct(
        min_block=low, max_block=most, min_frame=uint_be(c, 12, 3).cast("int"), max_frame=uint_be(c, 15, 3).cast("int"),
        sample_rate=rate, channels=F.shiftright(b(12), 1).bitwiseAND(7) + 1, bits_per_sample=bps, total_samples=total,
        md5=part(c, 26, 16), level=F.when(most >= 4096, 8).when(most >= 2048, 5).otherwise(0),
    )
    return F.when(is_flac(c) & (size(c) >= 42), found)


FLAC_INFO = "FLAC: lossless audio, metadata read and frames kept as they are"


def wav_format(c: Column) -> Column:
    """The `fmt ` chunk where writers put it, right after the RIFF header."""
    found = _struct(
        audio_format=uint_le(c, 20, 2).cast("int"), channels=uint_le(c, 22, 2).cast("int"), sample_rate=uint_le(c, 24, 4).cast("int"),
        byte_rate=uint_le(c, 28, 4), block_align=uint_le(c, 32, 2).cast("int"), bits_per_sample=uint_le(c, 34, 2).cast("int"),
    )
    return F.when(is_wav(c) & (part(c, 12, 4) == literal("666D7420")) & (size(c) >= 44), found)


def png_header(c: Column) -> Column:
    return F.when(size(c) >= 26, _struct(width=uint_be(c, 16, 4), height=uint_be(c, 20, 4), bit_depth=byte(c, 24), color_type=byte(c, 25)))


def gif_header(c: Column) -> Column:
    return F.when(size(c) >= 10, _struct(version=F.decode(part(c, 3, 3), "ISO-8859-1"), width=uint_le(c, 6, 2).cast("int"), height=uint_le(c, 8, 2).cast("int")))


def pdf_version(c: Column) -> Column:
    return F.regexp_extract(F.decode(part(c, 0, 16), "ISO-8859-1"), r"^%PDF-(\d+\.\d+)", 1)


# --- MIME base64 ----------------------------------------------------------------------------------------------------


def base64_header_length(c: Column) -> Column:
    """Up to the first empty line from 33 on, and any line ends right after it; -1 if there is none."""
    at = position(c, "0D0A0D0A", 33)
    more = F.length(F.regexp_extract(F.decode(part(c, at + 4, 1024), "ISO-8859-1"), "^(?:\r\n)*", 0))
    return F.when(at >= 0, at + 4 + more).otherwise(-1).cast("int")


def line_case(lengths: Column) -> Column:
    """0: all lines are as long, 1: all but the last, 2: anything else; null without a line."""
    n = F.size(lengths)
    but_last = F.array_distinct(F.slice(lengths, 1, F.greatest(n - 1, F.lit(1))))
    return (
        F.when(n == 0, F.lit(None)).when(F.size(F.array_distinct(lengths)) == 1, 0).when(F.size(but_last) == 1, 1).otherwise(2)
    )


def lines_fit(lengths: Column) -> Column:
    """Lines of at most 255 characters, and at most 65534 of them."""
    return F.forall(lengths, lambda x: x <= 255) & (F.size(lengths) <= 65534)
