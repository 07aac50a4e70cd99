"""Word and shingle hashes of many texts at once, in numpy, straight from Arrow's buffers.

Hashes are 64 bit: a polynomial over the bytes of a word modulo 2**64, finished by a bit mixer. Prefix sums give the
hash of any byte range, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, kept for the next call."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, CHUNK), np.uint64(base))
        out[0] = 1
        kept = np.multiply.accumulate(out)
        if n > 4 * CHUNK:
            return kept
        _powers[base] = kept
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Rows first to last of a batch: their bytes, and the words, whose index in row r runs from row_word[r-first]."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_word: np.ndarray
    row_byte: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        x = _BYTES[_LOWER[self.data] if lower else self.data] * powers(BASE, n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=prefix[1:])
        h = (prefix[self.ends] - prefix[self.starts]) * powers(INVERSE, n)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole rows of about ``size`` bytes, so that memory follows the longest text and not the batch."""
    offsets, data = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        solid = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        begin, finish = solid.copy(), solid.copy()
        if len(part):
            begin[1:] &= ~solid[:-1] | edge[1:-1]
            finish[:-1] &= ~solid[1:] | edge[1:-1]
        starts = np.flatnonzero(begin)
        yield Chunk(first, last, part, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, at), at)
        first = last


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row; as many as there are words, the last n-1 of which run past the end and mean nothing."""
    out = np.zeros(len(words), np.uint64)
    for k, factor in enumerate(powers(0xD1342543DE82EF95, n + 1)[1 : n + 1]):
        if k < len(words):
            out[: len(words) - k] += words[k:] * factor
    return mix(out)


def shingle_sets(chunk: Chunk, n: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles); fewer words give one shingle, none give none."""
    words = chunk.hashes(lower)
    whole = grams(words, n)
    for row in range(chunk.first, chunk.last):
        a, b = chunk.row_word[row - chunk.first : row - chunk.first + 2]
        if b - a >= n:
            found = np.sort(whole[a : b - n + 1])
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        else:
            found = grams(np.append(words[a:b], np.uint64(b - a)), b - a + 1)[:1] if b > a else np.zeros(0, np.uint64)
        yield row, found
