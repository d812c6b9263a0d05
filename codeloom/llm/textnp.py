"""Byte-level text kernels shared by the operators that run numpy inside Spark tasks.

All of them take whole Arrow string columns: a column is one contiguous byte buffer plus
offsets, so a batch of documents is handled with array operations and no loop over documents.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Largest slice of a batch that one set of array operations takes; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = 1 << 16


def _splitmix_table(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = _splitmix_table(256, 11)
_POW = _splitmix_table(_POWERS, 23) | np.uint64(1)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word of each row, for words split at ASCII white space and row ends."""
    word = ~_WS[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if `lower`), the same in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = np.repeat(starts, lens) + within
    values = _BYTE[_LOWER[data[at]] if lower else data[at]] * _POW[within & (_POWERS - 1)]
    if len(values) and int(lens.max()) > _POWERS:
        values *= (2 * (within >> 16) + 1).astype(np.uint64)
    return mix64(np.add.reduceat(values, first) + lens.astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each row, and the row of each; a shorter row is one run."""
    counts = np.diff(first)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = _splitmix_table(width, 41) | np.uint64(1)
    rows = np.repeat(np.arange(len(counts)), counts)
    long = np.maximum(n - width + 1, 0)
    run = np.zeros(long, np.uint64)
    for k in range(width):
        run += words[k : k + long] * factor[k]
    inside = rows[:long] == rows[width - 1 : width - 1 + long] if long else np.zeros(0, bool)
    out, owner = mix64(run[inside]), rows[:long][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        single = np.array([
            np.sum(words[first[r] : first[r + 1]] * factor[: counts[r]]) + np.uint64(0xA5A5 * int(counts[r])) for r in short
        ], np.uint64)
        out = np.concatenate([out, mix64(single)])
        owner = np.concatenate([owner, short])
    return out, owner


def distinct_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ordered by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if not len(values):
        return values, rows
    new = np.empty(len(values), bool)
    new[0] = True
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end), the code points that start before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
