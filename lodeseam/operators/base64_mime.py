"""MIME base64 objects: header, lines, content, and the same bytes again."""

from __future__ import annotations

import binascii
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.bytes import part, size
from lodeseam.functions.detect import is_base64
from lodeseam.functions.headers import base64_header_length, line_case
from lodeseam.functions.registry import ID

def character_value(character: Column) -> Column:
    """0 to 63 for the characters of the alphabet, 64 for `=`, else 65."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
    at = F.call_function("instr", F.lit(letters), F.substring(character, 1, 1))
    return F.when((at > 0) & (F.length(character) > 0), at - 1).otherwise(65)


def _wrapped(data: bytes, lengths: list[int]) -> str:
    text, out, at = binascii.b2a_base64(data, newline=False).decode(), [], 0
    for n in lengths:
        out.append(text[at : at + n])
        at += n
    return "\r\n".join(out)


def wrap(data: Column, lengths: Column) -> Column:
    """base64 of data in lines of the given lengths, CR LF between them."""

    @F.arrow_udf("string")
    def run(data: pa.Array, lengths: pa.Array) -> pa.Array:
        rows = zip(data.to_pylist(), lengths.to_pylist(), strict=True)
        return pa.array([None if x is None or n is None else _wrapped(x, n) for x, n in rows], pa.string())

    return run(data, lengths)


_BODY = pa.struct([("line_len", pa.list_(pa.int32())), ("ends", pa.bool_()), ("decoded", pa.binary()), ("identical", pa.int32()), ("accepted", pa.bool_())])
BODY = "struct<line_len: array<int>, ends: boolean, decoded: binary, identical: int, accepted: boolean>"
_ALPHABET = re.compile(rb"[A-Za-z0-9+/]+={0,2}")


def _body(body: bytes, least: int) -> dict:
    """Lines, content, and how much of the body comes back when the content is encoded again in these lines."""
    ends = body.endswith(b"\r\n")
    lines = (body[:-2] if ends else body).split(b"\r\n")
    lengths, text = [len(x) for x in lines], b"".join(lines)
    out = {"line_len": lengths, "ends": ends, "decoded": None, "identical": 0, "accepted": False}
    if max(lengths) > 255 or len(lengths) > 65534 or len(text) % 4 or not _ALPHABET.fullmatch(text):
        return out
    out["decoded"] = data = binascii.a2b_base64(text)
    again = _wrapped(data, lengths).encode() + (b"\r\n" if ends else b"")
    if again == body:
        out["identical"] = len(body)
    else:
        a, b = (np.frombuffer(x[: min(len(again), len(body))], np.uint8) for x in (again, body))
        out["identical"] = int(np.argmax(a != b)) if (a != b).any() else len(a)
    return out | {"accepted": again == body and len(body) > least}


def decode(objects: DataFrame, key: str = "object_id", content: str = "content", least: int = 4) -> DataFrame:
    """A row for each MIME base64 object; native predicates choose them, their bodies are read in Arrow batches.

    header_length, line_len, line_case, ends (whether a line end follows the last line), decoded, identical (bytes of the
    re-encoded body equal to the original from its start), accepted: identical exceeds `least` and covers the body.
    """
    c = F.col(content)

    @F.arrow_udf(BODY)
    def run(body: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _body(x, least) for x in body.to_pylist()], _BODY)

    own = objects.filter(is_base64(c)).withColumn("header_length", base64_header_length(c)).filter("header_length >= 0")
    own = own.withColumn("_b", run(part(c, F.col("header_length"), size(c))))
    return own.select(
        key, F.lit(ID["BASE64"]).alias("format"), "header_length", part(c, 0, F.col("header_length")).alias("header"), "_b.line_len",
        line_case(F.col("_b.line_len")).cast("int").alias("line_case"), "_b.ends", "_b.decoded", "_b.identical", "_b.accepted",
    )


def rebuild(rows: DataFrame) -> DataFrame:
    """rows of `decode` with content, the object's bytes again."""
    body = F.concat(wrap(F.col("decoded"), F.col("line_len")), F.when(F.col("ends"), "\r\n").otherwise(""))
    return rows.withColumn("content", F.concat("header", F.encode(body, "ISO-8859-1")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings share from their starts: the range that holds the first difference is halved."""
    most = F.least(F.length(a), F.length(b))
    start = F.struct(F.lit(0).alias("lo"), most.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        same = F.substring(a, s["lo"] + 1, mid - s["lo"]) == F.substring(b, s["lo"] + 1, mid - s["lo"])
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, lambda s, k: F.when(s["lo"] < s["hi"], halve(s, k)).otherwise(s), lambda s: s["lo"])


def compare(a: DataFrame, b: DataFrame, key: str, content: str = "content", a_offset: int = 0, b_offset: int = 0) -> DataFrame:
    """(key, identical) of objects in two tables: equal bytes from two offsets on, up to the first difference."""
    text = lambda c, at: F.decode(part(c, at, size(c)), "ISO-8859-1")
    left = a.select(key, text(F.col(content), a_offset).alias("_a"))
    right = b.select(key, text(F.col(content), b_offset).alias("_b"))
    return left.join(right, key).select(key, common_prefix(F.col("_a"), F.col("_b")).alias("identical"))
