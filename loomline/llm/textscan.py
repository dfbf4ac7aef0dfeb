"""Words of many texts as numpy arrays, straight from Arrow buffers: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Texts are worked on in slices of about so many bytes, so that the working arrays stay in cache.
SLICE = 1 << 20
TABLE_PLACES = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (multiply and shift)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


_BYTE_MARKS = mix64(np.arange(TABLE_PLACES * 256, dtype=np.uint64))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[: offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `most` bytes; a larger row is a range of its own."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


def _cuts(data: np.ndarray, lo: int, hi: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes that end at a space, so that no word is cut."""
    while lo < hi:
        cut = min(lo + most, hi)
        while cut < hi:
            spaces = IS_SPACE[data[cut : min(cut + 4096, hi)]]
            if spaces.any():
                cut += int(spaces.argmax())
                break
            cut = min(cut + 4096, hi)
        yield lo, cut
        lo = cut


class Words:
    """Words of rows lo to hi: row (from 0), start and end byte, 64-bit marks of word and prefixes."""

    def __init__(self, data, offsets, lo=0, hi=None, prefixes=(), fold=True, alnum_only=False, marks=True):
        hi = len(offsets) - 1 if hi is None else hi
        parts = [_scan(data, offsets[lo : hi + 1], a, b, prefixes, fold, alnum_only, marks) for a, b in _cuts(data, int(offsets[lo]), int(offsets[hi]), SLICE)]
        joined = [np.concatenate(x) if x else None for x in zip(*parts, strict=True)] if parts else None
        if joined is None:
            empty = np.zeros(0, np.int64)
            joined = [empty, empty, empty, *[np.zeros(0, np.uint64)] * (len(prefixes) + 1)]
        self.row, self.start, self.end, self.mark, *self.prefix = joined
        self.rows = hi - lo

    @classmethod
    def parts(cls, data, offsets, lo, hi, prefixes=(), fold=True, alnum_only=False, marks=True, most=SLICE, backwards=False) -> Iterator[Words]:
        """Rows lo to hi in parts of about `most` bytes that end at a space (or a row), the last one first if `backwards`; `row` counts from lo in each."""
        cuts = _cuts(data, int(offsets[lo]), int(offsets[hi]), most)
        for a, b in reversed(list(cuts)) if backwards else cuts:
            part = cls.__new__(cls)
            part.row, part.start, part.end, part.mark, *part.prefix = _scan(data, offsets[lo : hi + 1], a, b, prefixes, fold, alnum_only, marks)
            part.rows = hi - lo
            yield part

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def _scan(data, offsets, lo, hi, prefixes, fold, alnum_only, marks):
    part = data[lo:hi]
    word = ~IS_SPACE[part]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    heads = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
    begins[heads] |= word[heads]
    tails = heads[heads > 0] - 1
    ends[tails] |= word[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start + lo, "right") - 1
    if not marks or not len(start):
        none = np.zeros(len(start), np.uint64)
        return [row, start + lo, end + lo, none, *[none] * len(prefixes)]
    lengths = end - start
    first = np.cumsum(lengths) - lengths
    raw = part[word]
    place = np.arange(len(raw)) - np.repeat(first, lengths)
    folded = (LOWER[raw] if fold else raw).astype(np.int64)
    terms = _BYTE_MARKS[np.minimum(place, TABLE_PLACES - 1) * 256 + folded]
    far = np.flatnonzero(place >= TABLE_PLACES)
    if len(far):
        terms[far] = mix64((place[far] * 256 + folded[far]).astype(np.uint64))
    if alnum_only:
        terms[~IS_ALNUM[raw]] = 0
    out = [mix64(np.add.reduceat(terms, first))]
    for n in prefixes:
        head = np.add.reduceat(np.where(place < n, terms, np.uint64(0)), first)
        out.append(np.where(lengths >= n, mix64(head + np.uint64(n)), np.uint64(0)))
    return [row, start + lo, end + lo, *out]


def code_points(data: np.ndarray, lo: int, hi: int) -> int:
    """Number of characters in bytes lo to hi."""
    return int(np.count_nonzero((data[lo:hi] & 0xC0) != 0x80))
