"""Fixed values of the data model: formats, codes, names.  Small dimensions, as rows and as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format ids, names, the letters of the type switch, leading bytes and whether a codec exists here.
FORMATS = (
    (0, "NONE", "", "", False),
    (1, "PDF", "p", "255044462D", False),
    (2, "ZIP", "z", "504B0304", True),
    (3, "GZIP", "g", "1F8B", True),
    (4, "PNG", "n", "89504E470D0A1A0A", False),
    (5, "GIF", "f", "474946383761", False),
    (6, "JPG", "j", "FFD8", False),
    (7, "MP3", "3", "FF", False),
    (8, "SWF", "s", "435753", True),
    (9, "BASE64", "m", "436F6E7465", True),
    (10, "BZIP2", "b", "425A68", True),
    (11, "ZLIB", "", "78", True),
    (12, "F_BRUTE", "", "", True),
    (13, "D_BRUTE", "", "", True),
    (14, "WAV", "", "52494646", False),
    (15, "FLAC", "", "664C6143", False),
)
ID = {name: k for k, name, *_ in FORMATS}

# Error codes and messages.
ERRORS = (
    (0, "Success"),
    (1, "Unknown error"),
    (2, "Nothing decompressed"),
    (3, "There is not enough space on disk"),
    (4, "Temporary file has disappeared"),
    (5, "Ignore position too big"),
    (6, "Identical bytes size bigger than 4 GB"),
    (7, "Recursion depth too big"),
    (8, "Recursion depth can only be set once"),
    (9, "Minimal identical size can only be set once"),
    (10, "Please don't use a space between the -o switch and the output filename"),
    (11, "More than one output file given"),
    (12, "More than one input file given"),
    (13, "CTRL-C detected"),
    (14, "Intense mode level limit too big"),
    (15, "Brute mode level limit too big"),
    (19, "Error recompressing data!"),
    (20, "Input stream has no valid PCF header"),
    (21, "Input stream was made with an incompatible version"),
    (22, "Brotli metadata compression is no longer supported"),
)

# Error codes of external codecs and messages.
CODEC_ERRORS = {
    0: "Success",
    -1: "Invalid parameter",
    -2: "Decompression failed",
    -3: "Compression failed",
    -4: "Operation not supported",
    -5: "External codec library not found",
    -6: "Required symbol not found in library",
    -7: "Library version mismatch",
}

# Ids of external codecs.
CODEC_TYPES = {
    0: "Kraken", 1: "Leviathan", 2: "Mermaid", 3: "Selkie", 4: "Hydra", 5: "BitKnit", 10: "Unity LZ4", 11: "Unity LZMA",
    20: "EA Sports", 21: "RAGE", 22: "REDengine", 255: "unknown",
}
UNKNOWN_ERROR = "Unknown error"

# RFC 1952 operating systems, by their code from 0.
GZIP_OS = (
    "FAT filesystem / MS-DOS",
    "Amiga",
    "VMS (or OpenVMS)",
    "Unix",
    "VM/CMS",
    "Atari TOS",
    "HPFS filesystem (OS/2 or NT)",
    "Macintosh",
    "Z-System",
    "CP/M",
    "TOPS-20",
    "NTFS filesystem (Windows NT)",
    "QDOS",
    "Acorn RISC OS",
)

# Names of deflate block types, and of levels.
BLOCK_TYPES = ("Stored", "Fixed", "Dynamic", "Reserved")
LEVELS = {
    1: "Fastest", 2: "Fast", 3: "Faster", 4: "Fast-Medium", 5: "Medium", 6: "Default", 7: "Slow-High", 8: "Slower", 9: "Slowest/Maximum",
}

# Names of formats that are listed as known but have no codec.
UNSUPPORTED = {
    "archive": ("cab", "iso", "tar"),
    "stream": ("brotli", "lzma", "lzo", "lzx", "rar", "zstd"),
    "media": ("aac", "avif", "bmp", "heic", "mkv", "mp4", "ogg", "tiff", "webm", "webp"),
    "external": tuple(n for k, n in CODEC_TYPES.items() if k != 255),
}


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split()[1] for x in schema.split(", ")]
    lits = [F.struct(*(F.lit(v).cast(k).alias(n) for v, k, n in zip(r, kinds, names, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*lits)))


def formats(spark: SparkSession) -> DataFrame:
    return _frame(spark, FORMATS, "id int, name string, switch_char string, magic string, supported boolean")


def error_codes(spark: SparkSession) -> DataFrame:
    return _frame(spark, ERRORS, "code int, message string")


def capabilities(spark: SparkSession, plugins: tuple[str, ...] = ()) -> DataFrame:
    """kind, name, supported: what can be expanded and rebuilt here, and what is only known by name."""
    rows = [("builtin", n.lower(), s) for _, n, _, _, s in FORMATS[1:]]
    rows += [(kind, n.lower(), n.lower() in plugins) for kind, names in UNSUPPORTED.items() for n in names]
    known = {n for _, n, _ in rows}
    rows += [("plugin", p, True) for p in plugins if p not in known]
    return _frame(spark, rows, "kind string, name string, supported boolean")


def _named(key: Column, names: dict, default: str) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key.cast("int")), F.lit(default))


def format_name(key: Column) -> Column:
    return _named(key, {k: n for k, n, *_ in FORMATS}, "UNKNOWN")


def error_message(code: Column, extra: Column | None = None) -> Column:
    """The message of a code, and below it what else is known."""
    text = _named(code, dict(ERRORS), UNKNOWN_ERROR)
    return text if extra is None else F.when(extra.isNotNull(), F.concat(text, F.lit("\n"), extra)).otherwise(text)


def gzip_os(code: Column) -> Column:
    return _named(code, dict(enumerate(GZIP_OS)), "Unknown")


def block_type(code: Column) -> Column:
    return _named(code, dict(enumerate(BLOCK_TYPES)), "Unknown")


def level_name(level: Column) -> Column:
    return _named(level, LEVELS, "Unknown/Default")


def codec_error(code: Column) -> Column:
    return _named(code, CODEC_ERRORS, UNKNOWN_ERROR)
