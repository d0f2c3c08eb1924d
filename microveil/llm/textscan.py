"""Vectorised text scanning shared by the operators that work on words.

A batch of texts is one byte buffer with offsets; words, word hashes and word
shingles of all its texts are found by a fixed number of array passes, so cost
is linear in bytes whatever the sizes of the texts. Hashes are 64 bits wide.

Edge cases: a null text counts as empty; an empty text has no words and no
shingles; a text of fewer than ``k`` words has one shingle, its whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))[LOWER]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64; kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first row, row after the last, bytes, offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, last, buf[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def words(data: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~white[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    before[off[:-1][off[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    start = np.flatnonzero(inside & before)
    return start, np.flatnonzero(inside & after) + 1, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A hash of each byte span; equal bytes (after codes) give equal hashes wherever they stand."""
    p, inv = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * p[:-1], out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of all texts, in order, and where each text's begin (one more entry)."""
    count = np.diff(first)
    got = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(got)))
    base = np.repeat(first[:-1] - at[:-1], got) + np.arange(at[-1])
    left = np.repeat(np.minimum(count, k), got)
    out = left.astype(np.uint64)
    for j in range(k):
        has = left > j
        if has.all():
            out = mix(out + h[base + j])
        else:
            out[has] = mix(out[has] + h[base[has] + j])
    return out, at
