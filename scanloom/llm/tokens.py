"""Vectorised word splitting and 64-bit hashing over Arrow string batches (numpy, no Python object per word).

Hashes are polynomials modulo 2**64 read off prefix sums, so any run of bytes or words is hashed in
constant time, followed by an avalanche step. They are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are hashed over so many bytes at a time (and the rest of the last word).
PIECE = 1 << 18
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising avalanche of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown per process."""
    key = (base, 0)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length() if size <= 1 << 23 else n
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[key] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _runs(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair."""
    prefix = np.empty(len(values) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(values * _power(base, len(values)), out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * _power(_inverse(base), len(values) + 1)[starts]


@dataclass
class Words:
    """The words of a batch of texts: ``first[i]:first[i+1]`` are those of text i."""

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.empty(0, np.uint8) if buffer is None else np.frombuffer(buffer, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, lower: bool) -> Words:
    """Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; ``lower`` maps A-Z only."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = np.empty(len(data) + 1, dtype=bool)
    np.logical_not(_IS_SPACE[data], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    edge = offsets[:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[:-1][edge]
    starts = np.flatnonzero(begins)
    closes = inside[:-1] & ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    closes[last] |= inside[:-1][last]
    ends = np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets).astype(np.int64)
    return Words(first, _word_hashes(data, starts, ends), starts, ends, data)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, taken over pieces of the data so that the prefix sums stay small."""
    out = np.empty(len(starts), dtype=np.uint64)
    edges = np.searchsorted(starts, np.arange(0, len(data) + PIECE, PIECE)) if len(starts) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            low, high = starts[a], ends[b - 1]
            piece = data[low:high].astype(np.uint64) + np.uint64(1)
            out[a:b] = mix(_runs(piece, _BYTE_BASE, starts[a:b] - low, ends[a:b] - low))
    return out


def grams(words: Words, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` consecutive words, and whether the run stays in one text."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    starts = np.arange(n)
    hashed = mix(_runs(words.hashes, _WORD_BASES[which], starts, starts + size) + np.uint64(size))
    limit = np.repeat(words.first[1:], words.counts)[:n]
    return hashed, starts + size <= limit


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text stays near ``max_bytes`` (one longer text makes its own batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths, dtype=np.int64) // max_bytes
        cuts = np.flatnonzero(np.diff(block)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)
