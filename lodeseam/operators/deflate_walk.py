"""The blocks of a raw deflate stream (RFC 1951): types, code counts, sizes; always ends, whatever the bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Blocks and output bytes after which a stream is given up.
MOST_BLOCKS, MOST_BYTES = 1 << 20, 1 << 28

# RFC 1951 order of code length codes, extra bits and bases of lengths and distances.
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
_LENGTH_EXTRA = (0,) * 8 + (1,) * 4 + (2,) * 4 + (3,) * 4 + (4,) * 4 + (5,) * 4 + (0,)
_DISTANCE_EXTRA = (0, 0) + tuple(k // 2 for k in range(28))
_LENGTH_BASE = (*(3 + sum(1 << e for e in _LENGTH_EXTRA[:k]) for k in range(28)), 258)


class Bits:
    """Bits of a byte string, the least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def read(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise EOFError("the stream has no end")
            self.held |= self.data[self.at] << self.n
            self.at, self.n = self.at + 1, self.n + 8
        out = self.held & ((1 << n) - 1)
        self.held, self.n = self.held >> n, self.n - n
        return out

    def align(self) -> None:
        drop = self.n % 8
        self.held, self.n = self.held >> drop, self.n - drop


def _table(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol of a canonical Huffman code."""
    out, code = {}, 0
    for length in range(1, max(lengths, default=0) + 1):
        for symbol, n in enumerate(lengths):
            if n == length:
                out[length, code] = symbol
                code += 1
        code <<= 1
    return out


def _symbol(bits: Bits, table: dict) -> int:
    code = 0
    for length in range(1, 16):
        code = code << 1 | bits.read(1)
        if (length, code) in table:
            return table[length, code]
    raise ValueError("no such code")


_FIXED = _table([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _table([5] * 30)


def _dynamic(bits: Bits) -> tuple[dict, dict, int, int]:
    n_lit, n_dist, n_code = bits.read(5) + 257, bits.read(5) + 1, bits.read(4) + 4
    lengths = [0] * 19
    for k in _ORDER[:n_code]:
        lengths[k] = bits.read(3)
    table, out = _table(lengths), []
    while len(out) < n_lit + n_dist:
        s = _symbol(bits, table)
        if s < 16:
            out.append(s)
        elif s == 16:
            if not out:
                raise ValueError("nothing to repeat")
            out += [out[-1]] * (3 + bits.read(2))
        else:
            out += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    return _table(out[:n_lit]), _table(out[n_lit : n_lit + n_dist]), n_lit, n_dist


def blocks(data: bytes):
    """(index, type, literal codes, distance codes, output bytes, last) of each block; raises at the first broken one."""
    bits, total = Bits(data), 0
    for index in range(MOST_BLOCKS):
        last, kind, size, codes = bits.read(1), bits.read(2), 0, (0, 0)
        if kind == 3:
            raise ValueError("reserved block type")
        if kind == 0:
            bits.align()
            size, check = bits.read(16), bits.read(16)
            if size ^ check != 0xFFFF:
                raise ValueError("a stored block's length doesn't hold")
            skip = size - bits.n // 8
            if skip < 0 or bits.at + skip > len(data):
                raise EOFError("the stream has no end")
            bits.at, bits.held, bits.n = bits.at + skip, 0, 0
        else:
            literals, distances, *codes = (*_FIXED, 288, 30) if kind == 1 else _dynamic(bits)
            while (s := _symbol(bits, literals)) != 256:
                if s < 256:
                    size += 1
                else:
                    if s > 285:
                        raise ValueError("no such length")
                    size += _LENGTH_BASE[s - 257] + bits.read(_LENGTH_EXTRA[s - 257])
                    d = _symbol(bits, distances)
                    if d > 29:
                        raise ValueError("no such distance")
                    bits.read(_DISTANCE_EXTRA[d])
                if total + size > MOST_BYTES:
                    raise ValueError("expands too far")
        total += size
        yield index, kind, codes[0], codes[1], size, bool(last)
        if last:
            return
    raise ValueError("too many blocks")


_OUT = pa.struct(
    [("num_blocks", pa.int32()), ("stored", pa.int32()), ("fixed", pa.int32()), ("dynamic", pa.int32()), ("lit_codes", pa.int32()), ("dist_codes", pa.int32()), ("output_bytes", pa.int64()), ("error", pa.string())]
)
ANALYSIS = "struct<num_blocks: int, stored: int, fixed: int, dynamic: int, lit_codes: int, dist_codes: int, output_bytes: bigint, error: string>"


def _analysis(data: bytes) -> dict:
    kinds, lit, dist, size, error = [0, 0, 0], 0, 0, 0, None
    try:
        for _, kind, a, b, n, _ in blocks(data):
            kinds[kind] += 1
            lit, dist, size = max(lit, a), max(dist, b), size + n
    except (EOFError, ValueError) as e:
        error = str(e)
    return {"num_blocks": sum(kinds), "stored": kinds[0], "fixed": kinds[1], "dynamic": kinds[2], "lit_codes": lit, "dist_codes": dist, "output_bytes": size, "error": error}


def analyse(content: Column) -> Column:
    """Counts of a stream's blocks; `error` says where it breaks off."""

    @F.arrow_udf(ANALYSIS)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _analysis(x) for x in column.to_pylist()], _OUT)

    return run(content)


@udtf(returnType="idx: int, block_type: int, lit_codes: int, dist_codes: int, output_bytes: bigint, last: boolean")
class DeflateBlocks:
    """A row a block; a broken stream has those before the break."""

    def eval(self, content: bytes):
        if content is None:
            return
        try:
            yield from blocks(bytes(content))
        except (EOFError, ValueError):
            return
