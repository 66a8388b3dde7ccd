"""Vectorised hashing of words, shingles and byte grams over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(_BASE | 1)
_ODD_INV = np.uint64(pow(_BASE | 1, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte; the second table gives A-Z those of a-z.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for i, base in enumerate((_ODD, _ODD_INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] the polynomial hash of buf[i:j], times the base to the power i."""
    up, _ = powers(len(buf))
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values[buf] * up, out=c[1:])
    return c


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a separator."""
    gap = np.empty(len(buf) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = SEPARATORS[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    c = prefix_hash(buf, values)
    _, down = powers(len(buf) + 1)
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def doc_words(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows offsets[0]..offsets[-1]: word hashes, starts, ends (in buf) and the row of each.

    A word that would run across the end of a row is cut there."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    own = buf[lo:hi]
    starts, ends = word_bounds(own)
    inner = offsets[1:-1] - lo
    inner = np.unique(inner[(inner > 0) & (inner < len(own))])
    if len(inner) and len(starts):
        k = np.searchsorted(starts, inner, "right") - 1
        crossed = (k >= 0) & (starts[np.maximum(k, 0)] < inner) & (inner < ends[np.maximum(k, 0)])
        cuts = inner[crossed]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets - lo, starts, "right") - 1
    return range_hashes(own, starts, ends, values), starts + lo, ends + lo, rows


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `size` words in a row; rows with fewer words, but any,
    give one for all their words. Repeats are kept."""
    count = np.bincount(rows, minlength=n_rows)
    k = len(words) - size + 1
    out_h, out_r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k > 0:
        h = np.zeros(k, np.uint64)
        for i in range(size):
            h *= _ODD
            h += words[i : i + k]
        ok = rows[:k] == rows[size - 1 :]
        out_h, out_r = mix(h[ok]), rows[:k][ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        h = np.full(len(short), 0x51ED, np.uint64)
        for i in range(size - 1):
            has = count[short] > i
            h[has] = h[has] * _ODD + words[first[has] + i]
        out_h, out_r = np.concatenate([out_h, mix(h ^ _M2)]), np.concatenate([out_r, short])
    return out_h, out_r


def distinct_shingles(buf: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of rows of lower-cased text: hashes sorted within each row,
    rows, and counts by row."""
    words, _, _, rows = doc_words(buf, offsets, LOWER_VALUES)
    n = len(offsets) - 1
    h, r = shingles(words, rows, n, size)
    if len(r) > 1 and (r[1:] < r[:-1]).any():  # rows with few words come last
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    edge = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]).tolist()
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a > 1:
            h[a:b].sort()
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
        h, r = h[keep], r[keep]
    return h, r, np.bincount(r, minlength=n)
