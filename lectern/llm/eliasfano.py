"""Elias-Fano sequences and the levels of an n-gram trie built of them."""

from __future__ import annotations

import numpy as np

WORD = np.uint64(64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of a fixed number of bits in a row, as 64-bit numbers, with one more for unaligned reads."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 1, np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(width) > WORD)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (WORD - shift[over]))
    return out


def read_bits(packed: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    value = packed[word] >> shift
    over = np.flatnonzero(shift + np.uint64(width) > WORD)
    value[over] |= packed[word[over] + 1] << (WORD - shift[over])
    return value & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence of numbers below 2**63: low bits as they are, high bits in unary.

    ``parts`` are plain arrays, which may lie in a memory-mapped file.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._ones: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = np.zeros((top >> width) + n + 1, np.uint8)
        high[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        low = pack_bits(values & np.uint64((1 << width) - 1), width)
        return cls(n, width, low, np.packbits(high, bitorder="little"))

    def access(self, index: np.ndarray) -> np.ndarray:
        if self._ones is None:
            self._ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        index = np.asarray(index, np.int64)
        upper = (self._ones[index] - index).astype(np.uint64) << np.uint64(self.width)
        return upper | read_bits(self.low, index, self.width)

    def successor(self, values: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | int | None = None) -> np.ndarray:
        """In low .. high, the first place of a number not below each value; high if there is none."""
        values = values.astype(np.uint64)
        lo = np.broadcast_to(np.asarray(low, np.int64), values.shape).copy()
        hi = np.broadcast_to(np.asarray(self.n if high is None else high, np.int64), values.shape).copy()
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                return lo
            mid = (lo[todo] + hi[todo]) // 2
            less = self.access(mid) < values[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high]


class Trie:
    """A trie of n-grams, level by level.

    ``roots`` are the sorted first words. A level has for each node of the level above a pointer to its first child; the
    pointers are monotone. Children are sorted words of so many bits in each level, made one monotone sequence by adding their
    parent's rank in units of the words' universe, so that a child is found by successor search among its parent's own children.
    Each node has the code of one of at most 256 values; ``backoff`` is what a node's children leave over.
    """

    def __init__(self, bits: list[int], roots: EliasFano, levels: list[tuple[EliasFano, EliasFano, np.ndarray, np.ndarray, np.ndarray]]):
        self.bits, self.roots, self.levels = bits, roots, levels

    @classmethod
    def of(cls, roots: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: list[int]) -> Trie:
        """``levels`` has for each level below the roots: each node's parent (its place in the level above), word and value,
        in order of both."""
        made, above = [], len(roots)
        for k, (parent, word, value) in enumerate(levels):
            pointers = np.searchsorted(parent, np.arange(above + 1))
            book, codes = quantise(value)
            given = np.bincount(levels[k + 1][0], quantised(levels[k + 1][2]), len(word)) if k + 1 < len(levels) else np.zeros(len(word))
            relative = (parent.astype(np.uint64) << np.uint64(bits[k])) + word.astype(np.uint64)
            made.append((EliasFano.of(pointers), EliasFano.of(relative), codes, book, (1 - given).astype(np.float32)))
            above = len(word)
        return cls(bits, EliasFano.of(roots), made)

    def root(self, word: np.ndarray) -> np.ndarray:
        """Ranks of first words; -1 where they are not in the trie."""
        return self._found(self.roots, word, np.zeros(len(word), np.int64), np.full(len(word), self.roots.n))

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Ranks of children in a level, counted from 0 below the roots; -1 where there is none or no parent."""
        pointers, words = self.levels[level][:2]
        out = np.full(len(parent), -1)
        here = np.flatnonzero(parent >= 0)
        if len(here) and words.n:
            rank = parent[here]
            wanted = (rank.astype(np.uint64) << np.uint64(self.bits[level])) + word[here].astype(np.uint64)
            out[here] = self._found(words, wanted, pointers.access(rank).astype(np.int64), pointers.access(rank + 1).astype(np.int64))
        return out

    @staticmethod
    def _found(sequence: EliasFano, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if not sequence.n:
            return np.full(len(wanted), -1)
        place = sequence.successor(wanted, low, high)
        there = place < high
        there[there] = sequence.access(place[there]) == wanted[there]
        return np.where(there, place, -1)

    def to_bytes(self) -> bytes:
        """A table of sizes, then all arrays, each at a multiple of 8 bytes."""
        arrays = [np.array(self.bits, np.int64), *self.roots.arrays()]
        for pointers, words, codes, book, backoff in self.levels:
            arrays += [*pointers.arrays(), *words.arrays(), codes, book, backoff]
        raw = [a.tobytes() + bytes(-a.nbytes % 8) for a in arrays]
        sizes = np.array([[len(a), a.nbytes] for a in arrays], np.int64)
        return np.array([len(arrays)], np.int64).tobytes() + sizes.tobytes() + b"".join(raw)

    @classmethod
    def view(cls, buffer) -> Trie:
        """A trie over bytes or a memory map, without a copy."""
        n = int(np.frombuffer(buffer, np.int64, 1)[0])
        sizes = np.frombuffer(buffer, np.int64, 2 * n, 8).reshape(n, 2)
        fano = [np.int64, np.uint64, np.uint8]
        level = [*fano, *fano, np.uint8, np.float32, np.float32]
        kinds = [np.int64, *fano, *level * ((n - 4) // len(level))]
        at, arrays = 8 + 16 * n, []
        for (length, size), kind in zip(sizes.tolist(), kinds, strict=True):
            arrays.append(np.frombuffer(buffer, kind, length, at))
            at += size + -size % 8

        def sequence(a: list[np.ndarray]) -> EliasFano:
            return EliasFano(int(a[0][0]), int(a[0][1]), a[1], a[2])

        levels = [(sequence(a[:3]), sequence(a[3:6]), *a[6:]) for a in (arrays[i : i + len(level)] for i in range(4, n, len(level)))]
        return cls(arrays[0].tolist(), sequence(arrays[1:4]), levels)


def quantise(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most 256 numbers and the code of each value: exact if there are no more, else the lower bounds of equal parts
    of the logarithm's range. No value is rounded up, so that shares of a whole never exceed it."""
    value = value.astype(np.float32)
    distinct, codes = np.unique(value, return_inverse=True)
    if len(distinct) > 256:
        edges = np.exp(np.linspace(np.log(distinct[0]), np.log(distinct[-1]), 256)).astype(np.float32)
        edges[0] = distinct[0]
        return edges, np.clip(np.searchsorted(edges, value, side="right") - 1, 0, 255).astype(np.uint8)
    return (distinct if len(distinct) else np.zeros(1, np.float32)), codes.astype(np.uint8)


def quantised(value: np.ndarray) -> np.ndarray:
    book, codes = quantise(value)
    return book[codes].astype(np.float64)
