"""Words and n-grams of many texts at once, as numpy arrays over the UTF-8 buffer of an Arrow column.

No Python object is made per word: a lookup table classes and lower-cases bytes, word borders are where the class
changes, and a word's hash is a difference of running polynomial sums, so that equal words have equal hashes. Such sums
have ready collisions among long words (Thue-Morse words of 1,024 letters are one), so words over ``LONG`` bytes are
hashed by xxHash instead. Two different words then hash alike with a chance of about 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1B54A32D192ED03)
BLOCK = 1 << 18
LONG = 64


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()
#: Digits, lower-case letters and every byte of a code point above 127.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: All but blank, tab, newline, vertical tab, form feed and carriage return.
SOLID = np.ones(256, dtype=bool)
SOLID[0x20] = False
SOLID[0x09:0x0E] = False

_powers: dict[str, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        row = np.full(max(n, BLOCK), base, dtype=np.uint64)
        row[0] = 1
        _powers[key] = np.multiply.accumulate(row)
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts, in order. ``offsets[i]:offsets[i + 1]`` are those of text i; starts and ends are bytes."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(self.starts):
            s = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, s + BLOCK, side="right")))
            n = int(self.ends[j - 1] - s)
            powers = _powers_of(BASE, n)[:n]
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data[s : s + n].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
            a, b = self.starts[i:j] - s, self.ends[i:j] - s
            out[i:j] = (sums[b] - sums[a]) * _powers_of(INVERSE, n + 1)[a] + (b - a).astype(np.uint64) * STEP
            i = j
        out = mix(out)
        long = np.flatnonzero(self.ends - self.starts > LONG)
        if len(long):
            import xxhash

            out[long] = [xxhash.xxh64_intdigest(self.data[self.starts[k] : self.ends[k]]) for k in long.tolist()]
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(where, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> Words:
    """Lower-case A-Z and take maximal runs of bytes of the given class; runs end where a text ends."""
    data = LOWER[data]
    inside = kind[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    before[full] = False
    after[full[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def runs(bounds: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Spans of rows of at most so many bytes, or one row."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, j
        i = j


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words at each place that has n words after it, borders of texts ignored."""
    m = max(0, len(words) - n + 1)
    out = words[:m].copy()
    for k in range(1, n):
        out *= STEP
        out ^= out >> np.uint64(29)
        out += words[k : k + m]
    return mix(out)


def window_hashes(words: np.ndarray) -> np.ndarray:
    """``grams`` of the rows of a matrix."""
    out = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        out *= STEP
        out ^= out >> np.uint64(29)
        out += words[:, k]
    return mix(out)


def gram_places(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``grams`` that stay within a text, and how many each text has."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    total = int(counts.sum())
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(total), counts
