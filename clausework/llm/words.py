"""Vectorised words, word hashes and shingles over Arrow string batches.

A word is a maximal run of bytes outside space and 0x09-0x0D. Hashes are 64 bits wide; operators that
decide on them alone say so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Docs:
    """Some documents: ``rows`` are their positions in the batch, the words are flat arrays."""

    rows: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    first: np.ndarray  # of document i, the words are first[i]:first[i + 1]
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each value begins; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each document, and start, end and hash of each word; positions are in ``data``."""
    base = int(bounds[0])
    part = data[base : int(bounds[-1])]
    if lower:
        part = _LOWER[part]
    n = len(part)
    if not n:
        return np.zeros(len(bounds), np.int64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, U64)
    ink = np.empty(n + 1, dtype=bool)
    np.logical_not(_IS_SPACE[part], out=ink[:n])
    ink[n] = False
    opens = ink[:n].copy()
    opens[1:] &= ~ink[: n - 1]
    inner = bounds[1:-1] - base
    inner = inner[inner < n]
    opens[inner] = ink[inner]
    start = np.flatnonzero(opens)
    if not len(start):
        return np.zeros(len(bounds), np.int64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, U64)
    closes = ink[:n] & ~ink[1:]
    closes[inner[inner > 0] - 1] = ink[inner[inner > 0] - 1]
    end = np.flatnonzero(closes) + 1
    at = np.flatnonzero(ink[:n])
    length = end - start
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    power = np.cumprod(np.full(int(length.max()), _STEP, dtype=U64))
    h = np.add.reduceat(_BYTE[part[at]] * power[place], np.cumsum(length) - length)
    h = mix(h + length.astype(U64) * _BASE)
    first = np.searchsorted(start, bounds - base).astype(np.int64)
    return first, start + base, end + base, h


def documents(column: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Docs]:
    """The column's documents in order, whole, in groups of about ``chunk`` bytes."""
    data, bounds = string_parts(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + chunk, side="right")) - 1)
        j = min(j, n)
        b = bounds[i : j + 1]
        yield Docs(np.arange(i, j), data, b, *word_hashes(data, b, lower))
        i = j


def shingles(h: np.ndarray, first: np.ndarray, width: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each document in order of place, and the first of each document.

    A document of fewer than ``width`` words has its whole word sequence as one shingle if ``short_whole``, else none.
    """
    n = np.diff(first)
    if not len(h):
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    acc = np.zeros(len(h), dtype=U64)
    for k in range(width):
        acc[: len(h) - k] = acc[: len(h) - k] * _STEP + h[k:] if k < len(h) else acc[:0]
    left = np.repeat(first[1:], n) - np.arange(len(h))
    keep = left >= width
    count = np.maximum(n - width + 1, 0)
    out = mix(acc)
    if short_whole:
        for d in np.flatnonzero((n > 0) & (n < width)):
            a = U64(0)
            with np.errstate(over="ignore"):
                for x in h[first[d] : first[d + 1]]:
                    a = a * _STEP + x
                out[first[d]] = mix(np.array([a + U64(n[d]) * _BASE], dtype=U64))[0]
            keep[first[d]] = True
        count = np.where((n > 0) & (n < width), 1, count)
    return out[keep], np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
