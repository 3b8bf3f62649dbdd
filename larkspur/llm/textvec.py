"""Vectorised word and shingle hashing over Arrow string buffers (runs inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64, at least n of each."""
    size = max([1 << max(16, int(n).bit_length()), *_powers])
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_P, inverse))
    return _powers[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(column: pa.Array, most: int = 2 << 20):
    """Slices (start, stop) of a string column of about ``most`` bytes each; one row at least."""
    if not len(column):
        return
    offsets = utf8(column)[1]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, len(column))
        start = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all space-separated words of all rows, and for each row the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < n]
    first[bounds] = inside[bounds]
    last = np.zeros(n, bool)
    last[:-1] = ~inside[1:]
    last[-1] = True
    last[bounds[bounds > 0] - 1] = True
    last &= inside
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _tables(n)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def word_parts(data: np.ndarray, offsets: np.ndarray, prefixes: range, suffixes: range) -> tuple[list[np.ndarray], np.ndarray]:
    """For all words as in ``word_hashes``: hashes of the whole word, of its first bytes and of its last bytes (0: shorter)."""
    _, rows = word_hashes(data, offsets)
    inside = np.append(data != 32, False)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | breaks))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | breaks[1:])) + 1 if len(data) else starts
    power, inverse = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64))
        parts = [mix((sums[ends] - sums[starts]) * inverse[starts], 1)]
        for n in prefixes:
            stop = np.minimum(starts + n, ends)
            parts.append(np.where(ends - starts >= n, mix((sums[stop] - sums[starts]) * inverse[starts], 100 + n), np.uint64(0)))
        for n in suffixes:
            start = np.maximum(ends - n, starts)
            parts.append(np.where(ends - starts >= n, mix((sums[ends] - sums[start]) * inverse[start], 200 + n), np.uint64(0)))
    return parts, rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and each row's first shingle; a row of 1 to k - 1 words has one shingle of them all."""
    counts = np.diff(rows)
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    firsts = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(counts)), per_row)
    start = rows[:-1][row] + (np.arange(firsts[-1]) - firsts[:-1][row])
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            there = j < counts[row]
            if len(start):
                out = out * _Q + np.where(there, words[np.minimum(start + j, len(words) - 1)] + np.uint64(j + 1), np.uint64(0))
    return mix(out), firsts
