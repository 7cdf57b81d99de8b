"""Operator 9. Similarity join of documents by Jaccard similarity of word shingles, in a metric space.

1 - Jaccard is a metric, so distances to pivots bound distances between documents. Unrelated texts share no shingle
and are all at distance 1 from each other, so document pivots alone cannot part a corpus: every text would tie with
every pivot. Therefore regions are made in two levels.

1. Pivots of one shingle. A text is nearer than 1 to such a pivot just if it holds the shingle. Of any total order
   of shingles, two linked texts share one among the first ``n - ceil(t n) + 1`` of either, so a text is put into the
   regions of those only. Texts are classed by their sets first: equal sets are one class. A first pass orders
   shingles by hash and counts the regions that come of it; shingles of large regions, and those that recur within
   runs of texts, are last in the order of the second pass, the most frequent at the very end. Before them come those
   of small regions, by a map of fixed size, as texts meet by chance in more shingles the more texts there are. So a
   common passage, of two texts or of many, makes no region as long as its texts hold enough of their own.
   Near texts share many shingles, whose regions hold the same classes: of those only the first in the order is kept,
   as each pair's least common shingle of them is there.
2. Document pivots. Each region's first pivot is its least class; all others are compared with it. Links join
   classes to components, and a region whose other classes are all in one component is done. Each region that is
   left is joined by itself: pivots make Voronoi regions, classes within the triangle inequality's window of a region
   are replicated to it, and regions are joined until they are small or no longer shrink; then pairs of different
   components are compared. Small regions are dealt to tasks many at a time, large ones in pairs of blocks, where
   blocks of one component are not paired.

Two bounds hold before any distance is taken. Linked sets differ in size by the similarity at most, and the places i
and j of their least common shingle add up to no more than their symmetric difference, ``n + m - 2 T``, as all that
is before them is not common; a class that is too late for the earliest of its region leaves it. Distances to document pivots are taken in a contraction of the space: a set's histogram
over 256 hash buckets, of one byte each. The L1 distance of two histograms is a metric and never more than the sets'
symmetric difference, which is at most ``(1 - t) / (1 + t) (n + m)`` for linked sets of sizes n and m. It parts
unrelated texts well, where 1 - Jaccard is 1 for all, and needs no text. Pairs that pass are compared exactly by their
texts; pairs within a component are skipped, as components need only enough links to connect them. So that a region
of many near copies is not compared all with all, level 2 has rounds: in the first, each class is paired with the few
nearest ones of other components, then components are joined, and so on with more of them, until in the last round
all that are still of different components are paired. A region of which no pair was left out is done and has no
further round. No link between components is lost.

Sets are compared as 64-bit hashes of shingles, and classes are known by a 64-bit hash of the set.

Edge cases: texts without words (null, empty, blank) have an empty set and link with nothing. Texts of fewer words
than a shingle are one shingle. Very long texts are taken whole; a run holds at least one text, so memory grows with
the longest one. Repeated rows are in one class. Rows without an id are joined like others, but give no id to a component. Columns other than doc_id and text are not read. Empty table: no rows.

Jobs run while the result is being planned; its steps are stored in the shared folder and deleted when they are used up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blobs import dealt, pack, pack_sorted, unpack, unpack_sorted
from lectern.llm.components import connected
from lectern.llm.storage import drop_folder, stored
from lectern.llm.wordarrays import SOLID, STEP, buffers, gram_places, grams, mix, runs, split_words
from lectern.llm.workers import tidy, tidy_group

SHINGLE, PERCENT = 4, 85
#: A region is large from so many classes on, and so many shingles of large regions may be sent to all tasks; if there
#: are more, only the larger regions count.
LARGE, LARGE_SHINGLES = 4, 1 << 20
BATCH_BYTES, PART_BYTES = 8 << 20, 2 << 20
#: Rows with texts that a Python worker gets at once.
BATCH_ROWS = 2_000
#: How much longer a prefix is in the first pass, whose map tells which shingles come late in the second.
WIDER = 1.5
#: Bits of the map of shingles that more than one text holds: so many for each document, and at most.
MAP_BITS_A_DOCUMENT, MAP_BITS = 128, 1 << 28
#: Classes whose ids may be broadcast to fetch their texts; beyond, that is a shuffled join.
BROADCAST_ROWS = 500_000
#: Classes of a region, or of a block of one, that one task joins.
BLOCK = 4_000
#: Documents for each shard that finds the shingles which several have.
SHARD_DOCS = 4_000
#: Rows of small regions that are dealt to one task.
SHARD_ROWS = 40_000
LEAF, PIVOTS, BUCKETS = 64, 8, 256
#: How many of a class's nearest ones are tried in each round of level 2; at last all.
ROUNDS = (4, 64, None)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = split_words(data, bounds, SOLID)
    hashes = words.hashes()
    counts = words.counts()
    places, sizes = gram_places(words.offsets, n)
    all_grams = grams(hashes, n)[places]
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i, c in enumerate(counts.tolist()):
        if c >= n:
            out.append(np.unique(all_grams[at[i] : at[i + 1]]))
        elif c:
            part = hashes[words.offsets[i] : words.offsets[i + 1]]
            out.append(grams(np.concatenate([part, np.full(1, c, np.uint64)]), c + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A hash of a set, as a signed number."""
    total = mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.array([len(shingles)], np.uint64) * STEP
    return int(signed(mix(total))[0])


def histogram(shingles: np.ndarray) -> bytes:
    counts = np.bincount((shingles & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def _linked(inter, union, percent):
    return 100 * inter >= percent * union


def _often(sets: list[np.ndarray]) -> bytes | None:
    """Shingles that at least three different sets of a run hold, and their numbers, as bytes."""
    if not sets:
        return None
    h, c = np.unique(np.concatenate(sets), return_counts=True)
    return np.stack([h[c >= 3], c[c >= 3].astype(np.uint64)]).tobytes() if (c >= 3).any() else None


def _in_order(s: np.ndarray, last: tuple[np.ndarray, np.ndarray], k: int, shared: np.ndarray | None = None) -> np.ndarray:
    """The first k of a set: by hash, but those that the map ``shared`` has after others, and those of ``last`` (shingles,
    ranks) at the end by their ranks."""
    names, ranks = last
    met = _in_map(s, shared) if shared is not None else np.zeros(len(s), bool)
    if not len(names):
        return np.concatenate([s[~met][:k], s[met]])[:k]
    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
    late = names[at] == s
    first = np.concatenate([s[~late & ~met][:k], s[~late & met]])[:k]
    if len(first) == k:
        return first
    rest = np.flatnonzero(late)
    rest = rest[np.argsort(ranks[at[rest]], kind="stable")][: k - len(first)]
    return np.concatenate([first, s[rest]])


NO_LAST = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, last: tuple[np.ndarray, np.ndarray] | None = None, shared: np.ndarray | None = None) -> DataFrame:
    """doc_id, key (null without words), n, prefix and histogram of each document; repeats in a run have neither of the
    latter. Without ``last`` also ``often``, once a run: shingles that recur in it, and prefixes are longer by ``WIDER``."""
    sent = docs.sparkSession.sparkContext.broadcast((last or NO_LAST, shared))
    counting = last is None

    wider = WIDER if counting else 1

    def make(batches):
        order, met = sent.value
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            for i, j in runs(bounds, BATCH_BYTES):
                seen: dict[int, np.ndarray] = {}
                for a, b in runs(bounds[i : j + 1], PART_BYTES):
                    a, b = a + i, b + i
                    sets = shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], n)
                    keys, prefixes, histograms = [], [], []
                    for s in sets:
                        key = set_key(s) if len(s) else None
                        keys.append(key)
                        if key is None or key in seen:
                            prefixes.append(None)
                            histograms.append(None)
                            continue
                        seen[key] = s if counting else s[:0]
                        prefixes.append(signed(_in_order(s, order, min(len(s), int(prefix_size(len(s), percent) * wider)), met)))
                        histograms.append(histogram(s))
                    often = [None] * len(sets)
                    if b == j and counting:
                        often[-1] = _often(list(seen.values()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(histograms, pa.binary()), pa.array(often, pa.binary())], ["doc_id", "key", "n", "prefix", "histogram", "often"])

    return docs.mapInArrow(tidy(make), "doc_id long, key long, n long, prefix array<long>, histogram binary, often binary")


def _recurring(made: DataFrame) -> DataFrame:
    """h and count of the shingles that recur within runs."""

    def read(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                h, c = np.frombuffer(raw, np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(c))], ["h", "c"])

    return made.filter("often is not null").select("often").mapInArrow(read, "h long, c long")


def large_shingles(rows: DataFrame, made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that go last, sorted, and their ranks by frequency: those of large regions, and those that recur within
    runs. There are LARGE_SHINGLES at most, the least number of texts being doubled until there are no more."""
    counts = rows.groupBy("h").agg(F.count("*").alias("c")).unionByName(_recurring(made).groupBy("h").agg(F.sum("c").alias("c")))
    counts = counts.groupBy("h").agg(F.max("c").alias("c")).filter(F.col("c") >= LARGE)
    counts = stored(counts, "join-large")
    least, sizes = LARGE, {r["l"]: r["n"] for r in counts.groupBy(F.floor(F.log2(F.col("c") / LARGE)).alias("l")).agg(F.count("*").alias("n")).collect()}
    while sum(n for k, n in sizes.items() if LARGE << k >= least) > LARGE_SHINGLES:
        least *= 2
    found = counts.filter(F.col("c") >= least).toArrow()
    drop_folder(counts)
    h, c = (found.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.argsort(h.view(np.uint64))
    h, c = h.view(np.uint64)[order], c[order]
    return h, np.lexsort((h, c)).argsort()


def _map_bits(n_docs: int) -> int:
    return min(MAP_BITS, max(1 << 16, 1 << (n_docs * MAP_BITS_A_DOCUMENT - 1).bit_length())) if n_docs else 1 << 16


def shared_shingles(made: DataFrame, bits: int) -> np.ndarray:
    """A map of fixed size in which a bit is set for each prefix shingle that more than one class or run has.

    Most shingles are one text's own; with the map those need not be shuffled with their classes. Runs send their
    distinct shingles once, as compressed sorted keys; each shard returns its part of the map.
    """
    shards = 1 << min(16, (made.count() // SHARD_DOCS).bit_length())
    part = bits // shards

    def send(batches):
        for batch in batches:
            column = batch.column(0)
            h = np.concatenate([np.zeros(0, np.int64), column.flatten().to_numpy(zero_copy_only=False)]).astype(np.int64).view(np.uint64)
            keys, counts = np.unique(mix(h), return_counts=True)
            if len(keys):
                shard = (keys >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
                rows = [(s, pack_sorted(keys[at]), pack(np.packbits(counts[at] > 1))) for s, at in dealt(shard)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "often"])

    def gather(table: pa.Table) -> pa.Table:
        keys, often = [], []
        for row in table.to_pylist():
            keys.append(unpack_sorted(row["keys"]))
            often.append(np.unpackbits(unpack(row["often"], np.uint8), count=len(keys[-1])))
        keys, often = np.concatenate(keys), np.concatenate(often)
        order = np.argsort(keys, kind="stable")
        keys, often = keys[order], often[order].astype(bool)
        often[1:] |= keys[1:] == keys[:-1]
        there = np.zeros(part, np.uint8)
        there[_bit_of(keys[often], bits) % part] = 1
        return pa.table({"shard": table.column("shard")[:1], "map": pa.array([np.packbits(there).tobytes()], pa.binary())})

    rows = made.filter("size(prefix) > 0").select("prefix").mapInArrow(tidy(send), "shard long, keys binary, often binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.groupBy("shard").applyInArrow(tidy_group(gather), "shard long, map binary").collect():
        out[row["shard"] * part // 8 : (row["shard"] + 1) * part // 8] = np.frombuffer(row["map"], np.uint8)
    return out


def _bit_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _in_map(h: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which shingles the map has. They are mixed first: a prefix has the least hashes, which would share a part of it."""
    bit = _bit_of(mix(h), 8 * len(shared))
    return (shared[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _prefix_rows(made: DataFrame, shared: np.ndarray) -> DataFrame:
    """key, n, h and its place of the prefix shingles that the map has."""
    sent = made.sparkSession.sparkContext.broadcast(shared)

    def keep(batches):
        for batch in batches:
            keys, n, prefix = batch.columns
            h = prefix.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bounds = prefix.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            place = (np.arange(len(h)) - bounds[row]).astype(np.int32)
            good = _in_map(h, sent.value)
            at = pa.array(row[good])
            yield pa.RecordBatch.from_arrays([keys.take(at), n.take(at).cast(pa.int32()), pa.array(signed(h[good])), pa.array(place[good])], ["key", "n", "h", "place"])

    return made.filter("size(prefix) > 0").select("key", "n", "prefix").mapInArrow(tidy(keep), "key long, n int, h long, place int")


def _compare(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact comparison of pairs of texts: a, b, linked. Texts that are not of their class are left out."""

    def run(batches):
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                sides = []
                for column in (part.column(2), part.column(3)):
                    coded = column.dictionary_encode()
                    data, bounds = buffers(coded.dictionary)
                    sets = [s for k, j in runs(bounds) for s in shingle_sets(data[bounds[k] : bounds[j]], bounds[k : j + 1] - bounds[k], n)]
                    sides.append([(sets[c], set_key(sets[c])) for c in coded.indices.to_pylist()])
                out = []
                for x, y, (s, ks), (t, kt) in zip(a, b, *sides, strict=True):
                    if ks == x and kt == y:
                        inter = len(np.intersect1d(s, t, assume_unique=True))
                        out.append((x, y, bool(_linked(inter, len(s) + len(t) - inter, percent))))
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["a", "b", "linked"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long, linked boolean")


def _near(h1: np.ndarray, h2: np.ndarray, n1, n2, percent: int) -> np.ndarray:
    """Whether histograms are near enough for their sets to be linked."""
    return np.abs(h1 - h2).sum(axis=1, dtype=np.int64) * (100 + percent) <= (n1 + n2) * (100 - percent)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)


def _near_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose histograms are near enough, and their distance. pairs: a, b, n_a, n_b, h_a, h_b."""

    def keep(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                h1, h2 = _matrix(part.column(4)), _matrix(part.column(5))
                good = _near(h1, h2, part.column(2).to_numpy(), part.column(3).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(good)) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "h_a", "h_b").mapInArrow(tidy(keep), "a long, b long")


def least_overlap(both, percent: int):
    """The least intersection of linked sets whose sizes add up to ``both``."""
    return -(-percent * both // (100 + percent))


class Region:
    """Classes of one region by their histograms. ``pairs`` gets rows (x, y, distance) of all that may be linked, or of each
    core class's ``most`` nearest ones; ``more`` says whether any were left out."""

    def __init__(self, histograms: np.ndarray, sizes: np.ndarray, places: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int, most: int | None = None):
        self.histograms, self.sizes, self.places, self.component, self.side, self.percent, self.most = histograms, sizes, places, component, side, percent, most
        self.radius = sizes * ((100 - percent) / percent)
        self.pairs: list[np.ndarray] = []
        self.more = False

    def test(self, core: np.ndarray, everyone: np.ndarray) -> None:
        """Compare each of the core with all of the others. The core comes first in everyone."""
        n, place, comp, side = (x[everyone] for x in (self.sizes, self.places, self.component, self.side))
        step = max(1, (1 << 18) // len(everyone))
        for i in range(0, len(core), step):
            c = slice(i, min(i + step, len(core)))
            m = n[c, None]
            good = comp[c, None] != comp
            good &= (side[c, None] != side) | (side == 2)
            good &= (100 * m >= self.percent * n) & (100 * n >= self.percent * m)
            good &= place[c, None] + place <= m + n - 2 * least_overlap(m + n, self.percent)
            if self.most is None:  # a pair within the core is met once
                good[:, : len(core)] &= np.arange(c.start, c.stop)[:, None] < np.arange(len(core))
            x, y = np.nonzero(good)
            x, y = core[x + i], everyone[y]
            found = []
            for k in range(0, len(x), 1 << 15):
                a, b = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                far = np.abs(self.histograms[a] - self.histograms[b]).sum(axis=1, dtype=np.int64)
                near = far * (100 + self.percent) <= (self.sizes[a] + self.sizes[b]) * (100 - self.percent)
                found.append(np.stack([a[near], b[near], far[near]], axis=1))
            if found:
                self.pairs.append(self._nearest(np.concatenate(found)))

    def _nearest(self, rows: np.ndarray) -> np.ndarray:
        if self.most is None or not len(rows):
            return rows
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
        first = np.concatenate(([True], np.diff(rows[:, 0]) != 0))
        rank = np.arange(len(rows)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        self.more |= bool((rank >= self.most).any())
        return rows[rank < self.most]

    def join(self, core: np.ndarray, window: np.ndarray) -> None:
        """Pairs within the core, and of core and window."""
        everyone = np.concatenate([core, window])
        if not len(core) or len(everyone) < 2 or (self.component[everyone] == self.component[everyone[0]]).all():
            return
        if len(everyone) <= LEAF:
            return self.test(core, everyone)
        pivots = core[np.linspace(0, len(core) - 1, min(PIVOTS, len(core))).astype(int)]
        distance = np.stack([np.abs(self.histograms[everyone] - self.histograms[p]).sum(axis=1, dtype=np.int64) for p in pivots], axis=1)
        nearest = distance[: len(core)].argmin(axis=1)
        parts = []
        for k in range(len(pivots)):
            mine = nearest == k
            if mine.any():
                own, radius = distance[: len(core)][mine, k], self.radius[core[mine]]
                inside = np.concatenate([mine, np.zeros(len(window), bool)])
                replicated = ~inside & (distance[:, k] <= (own + radius).max() + 1e-6) & (distance[:, k] >= (own - radius).min() - 1e-6)
                # Of two parts of the core, the pairs are found from the first.
                replicated[: len(core)] &= nearest > k
                parts.append((core[mine], everyone[replicated]))
        if max(len(c) + len(w) for c, w in parts) < 0.7 * len(everyone):
            for c, w in parts:
                self.join(c, w)
        else:
            self.test(core, everyone)


#: Pairs of classes; without b, a is a region of which pairs were left out.
CANDIDATES = "a long, b long"


def _join_regions(percent: int, most: int | None):
    """Join the regions of one task, each by itself."""

    def run(table: pa.Table) -> pa.Table:
        key, n, place, comp, side, h = (table.column(c).to_numpy() for c in ("key", "n", "place", "comp", "side", "h"))
        histograms = _matrix(table.column("histogram"))
        order = np.lexsort((key, h))
        # Repeats of a class in a region come from runs of different partitions.
        order = order[np.concatenate(([True], (np.diff(h[order]) != 0) | (np.diff(key[order]) != 0)))]
        ends = np.flatnonzero(np.concatenate((np.diff(h[order]) != 0, [True]))) + 1
        found, start, more = [np.zeros((0, 2), np.int64)], 0, []
        for end in ends.tolist():
            at = order[start:end]
            start = end
            region = Region(histograms[at], n[at].astype(np.int64), place[at].astype(np.int64), comp[at], side[at], percent, most)
            names, number = np.unique(comp[at], return_counts=True)
            largest = comp[at] == names[number.argmax()]  # no pair lies within it
            region.join(np.flatnonzero(~largest), np.flatnonzero(largest))
            more += [h[at[0]]] if region.more else []
            found += [key[at[p[:, :2]]] for p in region.pairs]
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.table({"a": np.concatenate([pairs[:, 0], np.array(more, np.int64)]), "b": pa.array([*pairs[:, 1].tolist(), *[None] * len(more)], pa.int64())})

    return run


def _texts(docs: DataFrame, keys: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """key and text of the wanted classes, of their documents with the least id; where none has one, found by the key."""
    reps = stored(keys.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "join-reps")
    small = reps.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(reps) if small else reps, "doc_id").select("key", "text")
    nameless = reps.filter("doc_id is null").select("key")
    if not nameless.isEmpty():
        found = found.unionByName(with_keys(docs.filter("doc_id is null"), n).join(nameless, "key").dropDuplicates(["key"]).select("key", "text"))
    texts = stored(found, "join-texts")
    drop_folder(reps)
    return texts


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Deal the classes of large regions to pairs of blocks.

    Components larger than a block have blocks of their own, and two of the same component are not paired.
    """
    parts = members.groupBy("h", "comp").agg(F.count("*").alias("size"))
    big = F.col("size") > block
    rest = parts.groupBy("h").agg(F.sum(F.when(~big, F.col("size")).otherwise(0)).alias("rest"))
    own = F.concat_ws("#", F.col("comp").cast("string"), F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / block)).cast("string"))
    mixed = F.concat(F.lit("m"), F.pmod(F.xxhash64("key"), F.greatest(F.ceil(F.col("rest") / block), F.lit(1))).cast("string"))
    placed = members.join(parts.filter(big).select("h", "comp", "size"), ["h", "comp"], "left").join(rest, "h")
    placed = stored(placed.select("h", "key", "n", "place", "comp", "histogram", F.when(F.col("size").isNotNull(), own).otherwise(mixed).alias("block"), F.when(F.col("size").isNotNull(), F.col("comp")).alias("alone")), "join-blocks")
    there = placed.select("h", "block", "alone").distinct()
    left = there.select("h", F.col("block").alias("b1"), F.col("alone").alias("alone1"))
    right = there.select("h", F.col("block").alias("b2"), F.col("alone").alias("alone2"))
    pairs = left.join(right, "h").filter("b1 <= b2 and not coalesce(alone1 = alone2, false)").select("h", "b1", "b2")
    pairs = stored(pairs, "join-block-pairs")
    first = placed.withColumnRenamed("block", "b1").join(pairs, ["h", "b1"]).withColumn("side", F.when(F.col("b1") == F.col("b2"), 2).otherwise(0))
    second = placed.withColumnRenamed("block", "b2").join(pairs.filter("b1 < b2"), ["h", "b2"]).withColumn("side", F.lit(1))
    names = ["h", "key", "n", "place", "comp", "histogram", "side", "b1", "b2"]
    return first.select(*names).unionByName(second.select(*names))


def _regions(rows: DataFrame) -> DataFrame:
    """h, pivot, its n and place, and size of the regions of several classes; of those that hold the same classes the first.

    The order of shingles is the same in all texts, so any pair of a region's classes meets earlier in the first one, and
    the bound by places is the wider there. Classes are told apart by the sums of the halves of a hash, besides the least
    and the greatest; one that occurs twice does so in all of its regions.
    """
    mark = F.xxhash64("key")
    halves = [F.sum(F.shiftrightunsigned(mark, 32)).alias("high"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]
    found = rows.groupBy("h").agg(F.min(F.struct("key", "n", "place")).alias("p"), F.max("key").alias("top"), F.count("*").alias("size"), *halves).filter("p.key <> top")
    found = found.groupBy(F.col("p.key").alias("pivot"), "top", "size", "high", "low").agg(F.min(F.struct("p.place", "h", "p.n")).alias("first"))
    return found.select("first.h", "pivot", F.col("first.n").alias("pivot_n"), F.col("first.place").alias("pivot_place"), "size")


def similarity_links(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, key, n) and links between them (a, b) that connect just what all links connect."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = stored(classes(docs, n, percent), "join-classes", BATCH_ROWS)
    bits = _map_bits(made.count())
    shared = shared_shingles(made, bits)
    rows = stored(_prefix_rows(made, shared), "join-prefixes")
    if shared.any():
        last = large_shingles(rows, made)
        drop_folder(made, rows)
        made = stored(classes(docs, n, percent, last, shared), "join-classes", BATCH_ROWS)
        rows = stored(_prefix_rows(made, shared_shingles(made, bits)), "join-prefixes")
    keys = stored(made.select("doc_id", "key", "n"), "join-keys")
    regions = stored(_regions(rows), "join-regions")

    # The first pivot of each region against all others there.
    apart = F.col("key") != F.col("pivot")
    sized = F.lit(100) * F.least("n", "pivot_n") >= F.lit(percent) * F.greatest("n", "pivot_n")
    both = F.col("n").cast("long") + F.col("pivot_n")
    placed = F.col("place") + F.col("pivot_place") <= both - 2 * F.ceil(F.lit(percent) * both / F.lit(100 + percent))
    pairs = stored(rows.join(regions, "h").filter(apart & sized & placed).select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "join-pairs")
    wide = regions.filter("size > 2").select("h", "pivot")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    facts = stored(made.filter("histogram is not null").join(wanted.distinct(), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("histogram").alias("histogram")), "join-facts")

    def side(x: str) -> DataFrame:
        return facts.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("histogram").alias(f"h_{x}"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select("a", "b").distinct(), "join-near")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        texts = _texts(docs, keys, wanted, n)
        both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        links = stored(_compare(both, n, percent).filter("linked").select("a", "b"), "join-links", BATCH_ROWS)
        drop_folder(pairs, texts)
        return links

    links = verified(_near_pairs(pairs.join(side("b"), "b").join(side("a"), "a"), percent))
    drop_folder(pairs, facts)

    # Regions whose classes, the pivot apart, are in more than one component.
    component = connected(links).select(F.col("node").alias("key"), F.col("label").alias("comp"))
    inside = stored(rows.join(wide, "h").filter(apart).join(component, "key", "left").select("h", "key", "n", "place", F.coalesce("comp", "key").alias("comp")), "join-inside")
    drop_folder(rows, regions)
    few = made.filter("histogram is not null").select("key", "histogram")

    names = ["h", "key", "n", "place", "comp", "histogram"]
    # Of classes that may be linked this adds up to 0 at most.
    late = F.lit(100 + percent) * F.col("place").cast("long") - F.lit(100 - percent) * F.col("n").cast("long")
    for most in ROUNDS:
        open_regions = inside.groupBy("h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("size"), F.min(late).alias("least")).filter("c1 <> c2").select("h", "size", "least")
        left = stored(inside.join(open_regions, "h").filter(late + F.col("least") <= 0).drop("least"), "join-open")
        seen = few.join(left.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        members = stored(left.join(seen, "key"), "join-members")
        small = members.filter(F.col("size") <= block)
        shards = max(1, -(-small.count() // SHARD_ROWS))
        dealt_out = small.select(*names, F.lit(2).alias("side"), F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
        found = dealt_out.groupBy("shard").applyInArrow(tidy_group(_join_regions(percent, most)), CANDIDATES)
        large = members.filter(F.col("size") > block)
        if not large.isEmpty():
            found = found.unionByName(_blocks(large.dropDuplicates(["h", "key"]).select(*names), block).groupBy("h", "b1", "b2").applyInArrow(tidy_group(_join_regions(percent, most)), CANDIDATES))
        found = stored(found.distinct(), "join-candidates")
        drop_folder(members, inside)
        inside = left
        pairs, more = found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("h"))
        if not pairs.isEmpty():
            links = links.unionByName(verified(pairs))
        if more.isEmpty():
            drop_folder(found)
            break
        component = connected(links).select(F.col("node").alias("key"), F.col("label").alias("now"))
        left = left.select("h", "key", "n", "place", "comp").join(more, "h", "left_semi")
        left = stored(left.join(component, "key", "left").select("h", "key", "n", "place", F.coalesce("now", "comp").alias("comp")), "join-inside")
        drop_folder(found, inside)
        inside = left
    drop_folder(made, inside)
    return keys, links


def keyed_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, key of its set, n_shingles, label of the component (null without words, as key), component_id."""
    keys, links = similarity_links(docs, n, percent, block)
    label = connected(links).select(F.col("node").alias("key"), "label")
    rows = stored(keys.join(label, "key", "left").withColumn("label", F.coalesce("label", "key")), "join-labels")
    least = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).filter("size > 1").drop("size")
    # Stored, so that a large component's rows need not meet in one task: it is broadcast if it is small, else joined with its skew split.
    least = stored(least, "join-least")
    return rows.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "label", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach."""
    return keyed_components(docs, n, percent, block).select("doc_id", "n_shingles", "component_id")


def with_keys(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """docs with ``key``, that of each text's set; null without words."""
    names = [c for c in docs.columns if c != "key"]
    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("key"))

    def make(batches):
        for batch in batches:
            data, bounds = buffers(batch.column(len(names)))
            keys = []
            for i, j in runs(bounds, PART_BYTES):
                keys += [set_key(s) if len(s) else None for s in shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.int64())], [*names, "key"])

    return rows.mapInArrow(tidy(make), docs.select(*names, F.lit(None).cast("long").alias("key")).schema)
