"""Word shingle sets and circulant MinHash signatures of many texts, as numpy arrays."""

from __future__ import annotations

import math

import numpy as np

from loomline.llm.textscan import Words, mix64

WIDTH = 5
#: Rows of a band, and the chance to miss a pair at the threshold that fixes how many bands there are.
BAND_ROWS, MISS = 5, 1e-5
_STEP = np.uint32(0x9E3779B1)
_SHINGLES_AT_ONCE = 4096


def band_count(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def shingle_marks(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit marks of all shingles, row by row, and each row's first index in them (one more than rows).

    A row of fewer words than `width` is one shingle; one without words has none.
    """
    bounds = words.bounds()
    counts = np.diff(bounds)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.append(0, np.cumsum(sizes))
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint64), first
    at = np.repeat(bounds[:-1] - first[:-1], sizes) + np.arange(total)
    length = np.repeat(np.minimum(counts, width), sizes)
    padded = np.append(words.mark, np.zeros(width, np.uint64))
    mark = length.astype(np.uint64)
    for i in range(width):
        mark = mix64(mark ^ np.where(i < length, padded[at + i], np.uint64(0)))
    return mark, first


def distinct(marks: np.ndarray) -> np.ndarray:
    marks = np.sort(marks)
    return marks[np.append(True, marks[1:] != marks[:-1])] if len(marks) else marks


def digest(marks: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    a, b = mix64(marks ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64), mix64(marks ^ np.uint64(0xC0FFEE1234)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 32-bit numbers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(marks: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation spreads the shingles, the second one, shifted circularly k times, gives coordinate k."""
    spread = (mix64(marks) >> np.uint64(32)).astype(np.uint32)
    shifts = (np.arange(coordinates, dtype=np.uint32) * _STEP)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(spread), _SHINGLES_AT_ONCE):
        np.minimum(least, _second(spread[None, lo : lo + _SHINGLES_AT_ONCE] + shifts).min(1), out=least)
    return least


def band_keys(least: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    bands = least.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix64(key ^ bands[:, i])
    return key.view(np.int64)
