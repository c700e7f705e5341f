"""Arrow string columns as flat byte arrays: words, hashes and shingles without Python strings.

Words are maximal runs of bytes that a 256-entry table doesn't call separators. A word's hash is a
polynomial in its bytes modulo 2**64, got from one running sum over the slice, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: For terms: letters, digits and every byte of a non-ASCII character belong to a word.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES * 2) + 1
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK, lower: bool = False):
    """(row of each word, first byte, byte after the last, hash)."""
    if lower:
        data = LOWER[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, h


def hash_words(texts: list[str], separators: np.ndarray = BLANK, lower: bool = False) -> np.ndarray:
    """The hash of each text taken as one word."""
    out = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        out.append(words(b, np.array([0, len(b)]), np.zeros(256, bool), lower)[3][:1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(row: np.ndarray, h: np.ndarray, rows: int, n: int = 5, size: np.ndarray | None = None):
    """(row, hash) of every run of n words of a row; a row of 1 to n-1 words has one of all its words.

    With the size of each word, (row, hash, size): the words of a run summed.
    """
    count = np.bincount(row, minlength=rows)
    m = len(h)
    sums = None if size is None else np.concatenate([[0], np.cumsum(size)])
    parts = []
    if m >= n:
        same = row[: m - n + 1] == row[n - 1 :]
        at = np.flatnonzero(same)
        acc = np.zeros(len(at), np.uint64)
        for k in range(n):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
        parts.append((row[at], mix(acc), None if sums is None else sums[at + n] - sums[at]))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        acc = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            acc[has] = acc[has] * np.uint64(0xD6E8FEB86659FD93) + h[first[has] + k]
        parts.append((short, mix(acc + count[short].astype(np.uint64)), None if sums is None else sums[first + count[short]] - sums[first]))
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), None if sums is None else np.zeros(0, np.int64))]
    out = tuple(np.concatenate([p[k] for p in parts]) for k in range(2 if sums is None else 3))
    return out
