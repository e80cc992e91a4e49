"""Vectorised hashing of words and word shingles for batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)  # a value for each byte
_BASE = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray, a: int = 0xBF58476D1CE4E5B9, b: int = 0x94D049BB133111EB) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(a)
    x ^= x >> _U(27)
    x *= _U(b)
    x ^= x >> _U(31)
    return x


def groups(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer text is a run of its own."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased), and the first word of each text, with the total at the end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    blank = _SPACE[low]
    before = np.empty(len(low), bool)
    before[0], before[1:] = True, blank[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(low))]
    before[inner] = True
    starts = np.flatnonzero(~blank & before)
    solid = low[~blank]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = (np.cumsum(~blank) - 1)[starts]
    lengths = np.diff(np.append(at, len(solid)))
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    parts = _BYTE[solid] * powers[np.arange(len(solid)) - np.repeat(at, lengths)]
    hashes = mix64(np.add.reduceat(parts, at) + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (its whole sequence, if it has fewer) and the text of each; in word order."""
    counts = np.diff(firsts)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    if n >= k:
        value = hashes[: n - k + 1].copy()
        for j in range(1, k):
            value = value * _BASE + hashes[j : n - k + 1 + j]
        inside = owner[: n - k + 1] == owner[k - 1 :]
        value, of = mix64(value[inside]), owner[: n - k + 1][inside]
    else:
        value, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.full(len(short), 0, np.uint64)
        for i, r in enumerate(short):
            v = _U(0)
            with np.errstate(over="ignore"):
                for h in hashes[firsts[r] : firsts[r + 1]]:
                    v = v * _BASE + h
            extra[i] = v
        value, of = np.concatenate([value, mix64(extra ^ _U(0x5851F42D4C957F2D))]), np.concatenate([of, short])
    return value, of


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, end to end; and where each text's begin, with the total at the end."""
    value, of = shingle_hashes(*words(data, offsets), k)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.searchsorted(of, np.arange(len(offsets)))
