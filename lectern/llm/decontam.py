"""Operator 3. Benchmark decontamination by suffix arrays of the training texts.

Words are lower-cased (A-Z) runs of ASCII digits, letters and all code points above 127. Every shard (a few MB of
whole documents of one batch) gets a suffix array over its words: places in the order of all the words that follow
them, made by prefix doubling. Every test suffix, that is each place of an item that has a whole window after it, is
binary-searched in it; from its neighbours there come the longest verbatim matches and where they are. Shards need no
shuffle, and the test side is sent to them in blocks of bounded size, one pass for each block.

The arrays are sparse without loss: only places where some window of the test side stands are suffixes, and only words
inside such windows are ranked, as no match of a window's length leaves them. Windows are found by 64-bit hashes and
compared word by word; a match of words is a match of their 64-bit hashes. Work and memory grow with the words of
a shard and of the items that occur in it, not with the product of their occurrences.

Edge cases: null or empty texts have no words and no hits; items without words have no windows; an item of fewer
words than a window is one window. Repeated rows are judged each. Very long texts are one shard each. Empty tables give
no rows, or no hits. Columns of ``docs`` that are named like a result give way to it; ``decontaminate`` returns all
columns of ``docs`` as they were. The size of the benchmark is asked while the result is planned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.wordarrays import ALNUM, buffers, grams, runs, split_words, window_hashes
from lectern.llm.workers import tidy

WINDOW = 10
#: Bytes of benchmark text sent to the executors at once, and of documents in a shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20


@dataclass
class Windows:
    """Distinct windows of one length: their sorted hashes, a place of each, and its items (flat, by offsets); all places
    of windows, which are the test suffixes, and the window at each."""

    length: int
    hashes: np.ndarray
    example: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    places: np.ndarray
    window: np.ndarray


@dataclass
class Tests:
    """Items as ranks of words in their vocabulary, the item and the row of each word, and windows by their length."""

    vocabulary: np.ndarray
    ranks: np.ndarray
    owner: np.ndarray
    row: np.ndarray
    windows: list[Windows]


def _grouped(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each group, one group after the other, and the groups' bounds."""
    pairs = np.unique(np.stack([group, value], axis=1), axis=0) if len(group) else np.zeros((0, 2), np.int64)
    return pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(n + 1))


def prepare(items: list[tuple[int, str | None]], window: int = WINDOW) -> Tests:
    data, bounds = buffers(pa.array([t for _, t in items], pa.string()))
    words = split_words(data, bounds, ALNUM)
    hashes = words.hashes()
    vocabulary = np.unique(hashes)
    ranks = np.searchsorted(vocabulary, hashes).astype(np.int64) + 1
    counts = words.counts()
    tests = Tests(vocabulary, ranks, np.repeat(np.array([i for i, _ in items], np.int64), counts), words.owners(), [])
    ahead = np.repeat(words.offsets[1:], counts) - np.arange(len(ranks))
    own = np.repeat(np.minimum(counts, window), counts)
    for n in np.unique(own).tolist():
        places = np.flatnonzero((own == n) & (ahead >= n))
        distinct, first, group = np.unique(grams(ranks.astype(np.uint64), n)[places], return_index=True, return_inverse=True)
        flat, offsets = _grouped(group.astype(np.int64), tests.owner[places], len(distinct))
        tests.windows.append(Windows(n, distinct, places[first], flat, offsets, places, group.astype(np.int64)))
    return tests


def _expand(index: np.ndarray, offsets: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index the values of its group, and which index each belongs to."""
    sizes = offsets[index + 1] - offsets[index]
    which = np.repeat(np.arange(len(index)), sizes)
    first = np.repeat(offsets[index] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return flat[first + np.arange(len(which))], which


class Suffixes:
    """Ranks of all suffixes of some strings of numbers, by prefix doubling.

    ``last`` is the place after each place's string. ``levels[k]`` numbers the first 2 ** k words from each place in
    order (fewer where the string ends, which sorts first).
    """

    def __init__(self, words: np.ndarray, last: np.ndarray):
        here = np.arange(len(words))
        self.last, self.levels = last, [np.unique(words, return_inverse=True)[1]]
        step, longest = 1, int((last - here).max()) if len(words) else 0
        while step < longest:
            number = self.levels[-1]
            after = np.where(here + step < last, number[np.minimum(here + step, len(words) - 1)] + 1, 0)
            self.levels.append(np.unique(number * (len(words) + 1) + after, return_inverse=True)[1])
            step *= 2

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from the places a and b on are the same."""
        total, a, b = np.zeros(len(a), np.int64), a.copy(), b.copy()
        left = np.minimum(self.last[a] - a, self.last[b] - b)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.flatnonzero(left >= 1 << k)
            same = inside[self.levels[k][a[inside]] == self.levels[k][b[inside]]]
            for x in (total, a, b):
                x[same] += 1 << k
            left[same] -= 1 << k
        return total


def _covered(places: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags of the words inside windows of n words at places."""
    cover = np.bincount(places, minlength=total + 1) - np.bincount(places + n, minlength=total + 1)
    return np.cumsum(cover[:total]) > 0


def _ends(chosen: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For words at chosen places, the index after the run of consecutive places of one owner that each is in."""
    cut = np.concatenate(((np.diff(chosen) != 1) | (np.diff(owner[chosen]) != 0), [True])) if len(chosen) else np.zeros(0, bool)
    stops = np.flatnonzero(cut) + 1
    return stops[np.searchsorted(stops, np.arange(len(chosen)), side="right")] if len(chosen) else stops


def _longest(tests: Tests, windows: Windows, ranks: np.ndarray, owner: np.ndarray, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest match from each place where a window stands, and a place of an item it is with. ``owner`` is the
    document of each word."""
    there = np.zeros(len(windows.hashes), bool)
    there[window] = True
    tested = windows.places[there[windows.window]]
    ours = np.flatnonzero(_covered(place, windows.length, len(ranks)))
    theirs = np.flatnonzero(_covered(tested, windows.length, len(tests.ranks)))
    words = np.concatenate([ranks[ours], tests.ranks[theirs]])
    last = np.concatenate([_ends(ours, owner), _ends(theirs, tests.row) + len(ours)])
    suffixes = Suffixes(words, last)
    at = np.searchsorted(ours, place)  # the suffixes of the array
    test = np.searchsorted(theirs, tested) + len(ours)
    array = at[np.argsort(suffixes.rank[at], kind="stable")]
    test = test[np.argsort(suffixes.rank[test], kind="stable")]
    # Where each test suffix belongs in the array; its neighbours share the most words with it.
    found = np.searchsorted(suffixes.rank[array], suffixes.rank[test], side="left")
    after = np.searchsorted(found, np.arange(len(array)), side="right")
    best, best_at = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
    for side in (after - 1, after):
        inside = np.flatnonzero((side >= 0) & (side < len(test)))
        n = suffixes.common(array[inside], test[side[inside]])
        better = inside[n > best[inside]]
        best_at[better] = theirs[test[side[better]] - len(ours)]
        best[inside] = np.maximum(best[inside], n)
    length, item = np.zeros(len(ours), np.int64), np.zeros(len(ours), np.int64)
    length[array], item[array] = best, best_at
    return length[at], item[at]


def search(tests: Tests, data: np.ndarray, bounds: np.ndarray):
    """Matches in one shard: words, hit words (flags), pairs (document, item), and for documents that have any, the
    longest match as rows (document, words, first word, item)."""
    words = split_words(data, bounds, ALNUM)
    counts, n = words.counts(), len(words.starts)
    hit = np.zeros(n, bool)
    found: list[np.ndarray] = []
    matches: list[np.ndarray] = []
    if n and len(tests.vocabulary):
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
        ranks = np.where(tests.vocabulary[at] == hashes, at + 1, 0)
        # How many known words of the same document follow from each place on.
        stop = np.where(ranks == 0, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        ahead = np.minimum(stop, np.repeat(words.offsets[1:], counts)) - np.arange(n)
        owner = words.owners()
        for windows in tests.windows:
            k = windows.length
            place = np.flatnonzero(ahead >= k)
            if not len(place):
                continue
            keys = _grams_at(ranks, place, k)
            window = np.minimum(np.searchsorted(windows.hashes, keys), len(windows.hashes) - 1)
            good = windows.hashes[window] == keys
            place, window = place[good], window[good]
            same = np.ones(len(place), bool)
            for j in range(k):
                same &= ranks[place + j] == tests.ranks[windows.example[window] + j]
            place, window = place[same], window[same]
            if not len(place):
                continue
            hit |= _covered(place, k, n)
            once = np.unique(np.stack([owner[place], window], axis=1), axis=0)
            item, which = _expand(once[:, 1], windows.offsets, windows.items)
            found.append(np.unique(np.stack([once[which, 0], item], axis=1), axis=0))
            length, their = _longest(tests, windows, ranks, owner, place, window)
            matches.append(np.stack([owner[place], length, place - words.offsets[owner[place]], tests.owner[their]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    longest = np.concatenate(matches) if matches else np.zeros((0, 4), np.int64)
    longest = longest[np.lexsort((longest[:, 2], -longest[:, 1], longest[:, 0]))]
    return words, hit, pairs, longest[np.unique(longest[:, 0], return_index=True)[1]]


def _grams_at(ranks: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """``grams`` at some places only."""
    if 2 * len(places) > len(ranks):
        return grams(ranks.astype(np.uint64), n)[places]
    table = np.empty((len(places), n), np.uint64)
    for k in range(n):
        table[:, k] = ranks[places + k]
    return window_hashes(table)


#: Columns that a pass adds: words; hit spans [start, end) in words; items; words, first word and item of the longest
#: verbatim match, the first one of them.
FOUND = [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.list_(pa.int32()))), ("hit_items", pa.list_(pa.int64())), ("longest_match", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.int64())]
FOUND_SPARK = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("hit_items", T.ArrayType(T.LongType())), T.StructField("longest_match", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("longest_item", T.LongType())]


def _pass(docs: DataFrame, tests: Tests, first: bool) -> DataFrame:
    """Add the matches with one block of items to those found before."""
    sent = docs.sparkSession.sparkContext.broadcast(tests)
    kept = [c for c in docs.columns if c not in dict(FOUND)] if not first else docs.columns

    def scan(batches):
        for batch in batches:
            data, bounds = buffers(batch.column(kept.index("text")))
            for i, j in runs(bounds, SHARD_BYTES):
                words, hit, pairs, longest = search(sent.value, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                before = None if first else [batch.column(len(kept) + k).slice(i, j - i).to_pylist() for k in range(1, len(FOUND))]
                spans, items = [[] for _ in range(j - i)], [[] for _ in range(j - i)]
                for doc in np.unique(pairs[:, 0]).tolist():
                    a, b = int(words.offsets[doc]), int(words.offsets[doc + 1])
                    e = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
                    spans[doc] = np.stack([np.flatnonzero(e == 1), np.flatnonzero(e == -1)], axis=1).tolist()
                for doc, item in pairs.tolist():
                    items[doc].append(item)
                most = [(0, None, None)] * (j - i)
                for doc, length, start, item in longest.tolist():
                    most[doc] = (length, start, item)
                if before:
                    spans = [_union(s, o) for s, o in zip(spans, before[0], strict=True)]
                    items = [sorted({*s, *o}) for s, o in zip(items, before[1], strict=True)]
                    most = [max(s, o, key=lambda m: (m[0], -(m[1] or 0))) for s, o in zip(most, zip(*before[2:], strict=True), strict=True)]
                columns = (words.counts(), spans, items, *([m[k] for m in most] for k in range(3)))
                new = [pa.array(x, kind) for x, (_, kind) in zip(columns, FOUND, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(kept))), *new], [*kept, *dict(FOUND)])

    return docs.mapInArrow(tidy(scan), T.StructType([*(docs.schema[c] for c in kept), *FOUND_SPARK]))


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*map(list, a), *map(list, b)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def blocks_of_items(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about so many bytes; one block at a time is on the driver."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with what was found in each: n_words, hit_spans, hit_items (sorted), longest_match, longest_at, longest_item. No shuffle."""
    clash = set(docs.columns) & set(dict(FOUND))
    if clash:
        docs = docs.drop(*clash)
    first = True
    for items in blocks_of_items(benchmark, block_bytes):
        docs = _pass(docs, prepare(items, window), first)
        first = False
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Only the documents in which no window of an item occurs, with their own columns."""
    names = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"own_{i}") for i, c in enumerate(names)))
    clean = find_matches(inner, benchmark, window).filter(F.size("hit_items") == 0)
    return clean.select(*(F.col(c if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(names)))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_at, longest_item."""
    found = find_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    names = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hit_items") > 0).alias("contaminated"), "longest_match", "longest_at", "longest_item")
