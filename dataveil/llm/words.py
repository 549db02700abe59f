"""Words of Arrow text columns as 64-bit hashes, a batch at a time, without a Python loop over words.

Every function works on whole texts. Batches are walked in chunks of a few MB of text, so that memory
is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others (splitmix64's finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least *n* of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _powers[:] = [
            np.cumprod(np.full(size, base % (1 << 64), dtype=np.uint64))
            for base in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, a null as an empty text, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most *limit* bytes of text, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the given rows, A-Z lower-cased, and each row's first word's number.

    A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
    return; it never spans two rows. *offsets* start at 0.
    """
    n_rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    data = _LOWER[raw]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    power, inverse = _power_tables(len(data))
    values = _BYTE[data]
    values *= power[: len(data)]
    values *= inside
    return mix(np.add.reduceat(values, starts) * inverse[starts]), at


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of *width* consecutive words of a row and each row's first one's number.

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    count = np.diff(at)
    kept = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.zeros(len(at), np.int64)
    np.cumsum(kept, out=first[1:])
    if not len(words):
        return np.zeros(0, np.uint64), first
    place = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], kept)
    length = np.repeat(np.minimum(count, width), kept)
    out = mix(words[place] ^ length.astype(np.uint64))
    for step in range(1, width):
        more = length > step
        nxt = words[np.minimum(place + step, len(words) - 1)]
        out = np.where(more, mix(out * _U(_BASE) + nxt), out)
    return out, first


def rows_of_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row) for chunks of a text column."""
    raw, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        hashes, at = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, hashes, at
