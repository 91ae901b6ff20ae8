"""Table functions that walk a file's parts: one row a chunk, metadata block, record, stream or embedded header."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Leading bytes that are looked for inside objects, with the strictness that a chance match needs.
_EMBEDDED = re.compile(
    rb"(?P<gzip>\x1f\x8b\x08[\x00-\x1f])|(?P<bzip2>BZh[1-9]1AY&SY)|(?P<zip>PK\x03\x04)|(?P<png>\x89PNG\r\n\x1a\n)|(?P<pdf>%PDF-)"
    rb"|(?P<zlib>\x78[\x01\x5e\x9c\xda])|(?P<gif>GIF8[79]a)|(?P<flac>fLaC\x80?\x00)|(?P<swf>CWS)|(?P<wav>RIFF....WAVE)",
    re.DOTALL,
)
#: Ids of the formats above.
_IDS = {"pdf": 1, "zip": 2, "gzip": 3, "png": 4, "gif": 5, "swf": 8, "bzip2": 10, "zlib": 11, "wav": 14, "flac": 15}
_SURE = {"zlib": 40, "swf": 50, "pdf": 95, "png": 100}


@udtf(returnType="idx: int, tag: string, offset: bigint, size: bigint")
class RiffChunks:
    """The chunks of a RIFF file: data offset and size as stated; nothing if it isn't one of 12 bytes or more."""

    def eval(self, content: bytes):
        if content is None or len(content) < 12 or content[:4] != b"RIFF":
            return
        at, idx = 12, 0
        while at + 8 <= len(content):
            size = int.from_bytes(content[at + 4 : at + 8], "little")
            yield idx, bytes(content[at : at + 4]).decode("latin-1"), at + 8, size
            at, idx = at + 8 + size + (size & 1), idx + 1


@udtf(returnType="idx: int, block_type: int, offset: bigint, size: bigint, last: boolean")
class FlacBlocks:
    """The metadata blocks of a FLAC file, up to the last or the first that isn't all there."""

    def eval(self, content: bytes):
        if content is None or content[:4] != b"fLaC":
            return
        at, idx = 4, 0
        while at + 4 <= len(content):
            head, size = content[at], int.from_bytes(content[at + 1 : at + 4], "big")
            yield idx, head & 127, at + 4, size, bool(head & 128)
            if head & 128:
                return
            at, idx = at + 4 + size, idx + 1


def flac_summary(blocks: DataFrame, key: str = "object_id") -> DataFrame:
    """Of each object's metadata blocks: which kinds it has, and the bytes of its padding."""
    kinds = {"has_seektable": 3, "has_vorbis_comment": 4, "has_cuesheet": 5, "has_picture": 6}
    has = [F.bool_or(F.col("block_type") == k).alias(name) for name, k in kinds.items()]
    return blocks.groupBy(key).agg(*has, F.sum(F.when(F.col("block_type") == 1, F.col("size")).otherwise(0)).alias("padding"))


@udtf(returnType="idx: int, kind: string, offset: bigint, size: bigint, detail: int")
class GifRecords:
    """The records of a GIF file: screen, colour tables, extensions, images; detail: an image's block size or an extension's label."""

    def eval(self, content: bytes):
        if content is None or len(content) < 13 or content[:6] not in (b"GIF87a", b"GIF89a"):
            return
        idx, at = 0, 13
        yield idx, "screen", 6, 7, content[10]
        if content[10] & 128:
            size = 3 << ((content[10] & 7) + 1)
            idx += 1
            yield idx, "colors", at, size, content[10] & 7
            at += size
        while at < len(content):
            begin, mark, idx = at, content[at], idx + 1
            if mark == 0x3B:
                yield idx, "end", at, 1, 0
                return
            if mark == 0x21 and at + 2 <= len(content):
                detail, at = content[at + 1], at + 2
            elif mark == 0x2C and at + 10 <= len(content):
                packed = content[at + 9]
                at += 10 + ((3 << ((packed & 7) + 1)) if packed & 128 else 0) + 1
                detail = content[at] if at < len(content) else 0
            else:
                return
            while at < len(content) and content[at]:
                at += content[at] + 1
            at += 1
            yield idx, "extension" if mark == 0x21 else "image", begin, min(at, len(content)) - begin, detail


def _marks(content: bytes, mark: int) -> list[int]:
    """The bits where 48 bits stand: of each of eight shifts the five whole bytes are searched, then the edges compared."""
    out = []
    for shift in range(8):
        wide, mask = mark << 8 - shift, (1 << 48) - 1 << 8 - shift
        middle = wide.to_bytes(7, "big")[1:6]
        at = content.find(middle, 1)
        while at >= 0:
            bits = int.from_bytes(content[at - 1 : at + 6].ljust(7, b"\0"), "big")
            if bits & mask == wide and 8 * (at - 1) + shift + 48 <= 8 * len(content):
                out.append(8 * (at - 1) + shift)
            at = content.find(middle, at + 1)
    return sorted(out)


@udtf(returnType="idx: int, bit_offset: bigint, bits: bigint")
class Bzip2Blocks:
    """The blocks of a bzip2 file by their 48-bit mark, which stands at any bit; bits: up to the next mark or the end."""

    def eval(self, content: bytes):
        if content is None or content[:3] != b"BZh":
            return
        found, ends = _marks(bytes(content), 0x314159265359), _marks(bytes(content), 0x177245385090)
        stop = ends[-1] if ends and ends[-1] > (found[-1] if found else 0) else 8 * len(content)
        for k, at in enumerate(found):
            yield k, at, (found[k + 1] if k + 1 < len(found) else stop) - at


@udtf(returnType="offset: bigint, format: int, confidence: int")
class EmbeddedHeaders:
    """Where headers of known formats stand inside an object, from the second byte on."""

    def eval(self, content: bytes):
        if content is None:
            return
        for found in _EMBEDDED.finditer(bytes(content), 1):
            yield found.start(), _IDS[found.lastgroup], _SURE.get(found.lastgroup, 90)
