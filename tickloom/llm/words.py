"""Vectorised word and shingle hashes over the bytes of Arrow text batches.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on the characters. A word's hash is a polynomial over its bytes modulo 2**64, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers[0].size < size:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of a text column, about ``budget`` bytes or one long text each."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end byte of every word."""
    inside = ~_SPACE[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < data.size)]
    first[cuts[inside[cuts]]] = True
    last[cuts[inside[cuts - 1]] - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _tables(data.size + 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_CODES[data] * up[:data.size], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def shingles(rows: int, row: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words, by row, and their offsets; a row of 1 to k-1 words gives one run of all its words."""
    def fold(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(at.size, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
        return mix(h)

    counts = np.bincount(row, minlength=rows)
    at = np.flatnonzero(row[k - 1:] == row[:row.size - k + 1]) if row.size >= k else np.zeros(0, np.int64)
    owner, hashes = [row[at]], [fold(at, k)]
    begin = np.concatenate([[0], np.cumsum(counts)])
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if short.size:
            owner.append(short)
            hashes.append(fold(begin[short], n))
    if len(owner) > 1:
        who, out = np.concatenate(owner), np.concatenate(hashes)
        order = np.argsort(who, kind="stable")
        who, out = who[order], out[order]
    else:
        who, out = owner[0], hashes[0]
    return out, np.concatenate([[0], np.cumsum(np.bincount(who, minlength=rows))])


def text_shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, shingle hashes, offsets)`` for slices of a text column."""
    for at, to, data, offsets in text_slices(column):
        row, start, end = word_spans(data, offsets)
        hashes, cuts = shingles(to - at, row, word_hashes(data, start, end), k)
        yield at, to, hashes, cuts
