"""Words of whole texts as Arrow and numpy arrays, for operators that work on batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a batch operator works on; a longer text is a step of its own.
STEP_BYTES = 2_000_000

#: ASCII letters lower-cased, ASCII digits and every byte over 7F kept, the rest a space: one byte for one byte.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)

#: The first 0 to 8 bytes of eight, and an odd factor.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def plain(text: pa.Array) -> pa.Array:
    """A contiguous copy with null as the empty text."""
    return pa.concat_arrays([pc.fill_null(text.cast(pa.string()), "")])


def alnum(text: pa.Array) -> pa.Array:
    """Texts with everything but lower-cased ASCII letters, digits and non-ASCII characters blanked."""
    text = plain(text)
    _, offsets, data = text.buffers()
    if data is None:
        return text
    return pa.StringArray.from_buffers(
        len(text), offsets, pa.py_buffer(data.to_pybytes().translate(_ALNUM)), None, 0, text.offset
    )


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and how many each text has; null has none."""
    lists = pc.ascii_split_whitespace(plain(text))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    cuts = before[np.concatenate(([0], ends)).astype(np.int64)]
    return words.filter(full), np.diff(cuts).astype(np.int64)


def starts(counts: np.ndarray) -> np.ndarray:
    """Offset of each document in the flat array, and the end."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight of them at a time for all words that are so long."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not lengths.any():
        return mixed(lengths.view(np.uint64))
    _, offsets, data = words.buffers()
    begins = np.frombuffer(offsets, np.int32, len(words), 4 * words.offset).astype(np.int64)
    last = int(begins[-1] + lengths[-1])
    padded = np.zeros(last + 8, np.uint8)
    padded[:last] = np.frombuffer(data, np.uint8, last)
    eights = np.ndarray((last + 1,), "<u8", padded, strides=(1,))  # of every place the eight bytes from it on
    out, at, left, own = mixed(lengths.view(np.uint64)), begins, lengths, None
    while len(at):
        part = eights[at] & _FIRST[np.minimum(left, 8)]
        if own is None:
            out = mixed(out * _TIMES ^ part)
        else:
            out[own] = mixed(out[own] * _TIMES ^ part)
        more = np.flatnonzero(left > 8)
        own = more if own is None else own[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` consecutive word hashes, built by doubling: h(2n) from two h(n)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, done = None, hashes, 0
    size, left = 1, length
    while left:
        if left & 1:
            part = have[done : done + n]
            out = mixed(part) if out is None else mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += size
        left >>= 1
        if left:
            have = mixed(have[: len(have) - size] * np.uint64(0xD6E8FEB86659FD93) + have[size:])
            size *= 2
    return out


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then those of the next."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(total) + np.repeat(lo - (ends - n), n)
