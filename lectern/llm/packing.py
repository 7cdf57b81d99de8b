"""Operator 5. Best-fit packing of documents into sequences of a fixed length.

Bounded-space online best-fit: at most a fixed number of bins is open. They are kept by their free space, and a
bitset has a bit for each free space that an open bin has, so the best bin for a piece is the lowest set bit from
its length up. If no open bin takes the piece and all are open, the fullest one closes first.

Every partition packs its own pieces. Bins that are still open at its end are not closed there: their pieces go on
to the next round with fewer partitions, down to one, so that the number of part-filled sequences does not grow
with the number of partitions. Each round is written to the shared folder before the next one reads it.

A document longer than a sequence is cut from its end into full pieces; the rest is its first piece.

Edge cases: null and empty text: the end id alone. Repeated rows: each is packed. Very long texts are encoded whole and cut to pieces. Bins of equal
free space are taken in the order in which they were opened. Columns other than doc_id and text are not read. Empty
table: no rows. Rounds run while the result is planned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.pieces import END_ID, TEXTS, encoder, forget, text_runs
from lectern.llm.storage import stored
from lectern.llm.workers import tidy

#: Rows with texts that a Python worker gets at once.
BATCH_ROWS = 2_000
CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces for each task of the first round, and by how much each further round has fewer tasks.
PIECES_A_TASK, FEWER = 100_000, 16


class BestFit:
    """Open bins by free space. ``add`` and ``close`` return the bins that closed, each a list of items."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS):
        self.capacity, self.bins = capacity, bins
        self.mask, self.count, self.at = 0, 0, {}

    def _take(self, free: int) -> list:
        row = self.at[free]
        items = row.pop()
        if not row:
            del self.at[free]
            self.mask ^= 1 << free
        self.count -= 1
        return items

    def add(self, item, length: int) -> list[list]:
        closed, fits = [], self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if self.count >= self.bins:
                closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, items = self.capacity, []
        items.append(item)
        free -= length
        if not free:
            return [*closed, items]
        self.at.setdefault(free, []).append(items)
        self.mask |= 1 << free
        self.count += 1
        return closed

    def close(self) -> list[list]:
        left = [items for free in sorted(self.at) for items in self.at[free]]
        self.mask, self.count, self.at = 0, 0, {}
        return left


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and end of each piece of a document of n ids."""
    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return list(zip(bounds, bounds[1:], strict=False))


def piece_rows(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its ids if asked for."""

    def rows(batches):
        for batch in batches:
            docs, column = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(docs), TEXTS):
                texts = column.slice(i, TEXTS).to_pylist()
                for span in text_runs(texts):
                    out: list[list] = [[] for _ in range(6)]
                    for doc, raw in zip(docs[i:][span], encoder(vocabulary).encode(texts[span]), strict=True):
                        raw += END_ID.to_bytes(4, "little")
                        for k, (a, b) in enumerate(cut(len(raw) // 4, capacity)):
                            part = raw[4 * a : 4 * b]
                            for column_, value in zip(out, (doc, k, a, b - a, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                                column_.append(value)
                    arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.array(out[5], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows_in.mapInArrow(tidy(rows, forget), PIECE + (", ids array<int>" if with_ids else ""))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, bins: int = OPEN_BINS) -> DataFrame:
    """Give each piece of a stored table its sequence and its offset there."""
    partitions, level, done = max(1, -(-pieces.count() // PIECES_A_TASK)), 0, None
    names = pieces.columns
    while True:
        last = partitions == 1

        def pack(batches, level=level, last=last):
            task, number = TaskContext.get().partitionId(), 0
            open_bins = BestFit(capacity, bins)

            def table(closed: list[list], still_open: bool) -> pa.RecordBatch:
                nonlocal number
                rows, sequence, offset = [], [], []
                for items in closed:
                    at = 0
                    for item in items:
                        rows.append(item)
                        sequence.append(level << 58 | task << 34 | number)
                        offset.append(at)
                        at += item[3]
                    number += 1
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                arrays += [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array([still_open] * len(rows), pa.bool_())]
                return pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset", "still_open"])

            for batch in batches:
                closed = []
                for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    closed += open_bins.add(item, item[3])
                yield table(closed, False)
            yield table(open_bins.close(), not last)

        mixed = pieces.repartition(partitions, "doc_id", "piece").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
        packed = stored(mixed.mapInArrow(tidy(pack), f"{PIECE}, sequence_id long, offset long, still_open boolean"), f"packed-{level}")
        closed = packed.filter(~F.col("still_open")).drop("still_open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        pieces, partitions, level = packed.filter("still_open").select(*names), -(-partitions // FEWER), level + 1


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, bins: int = OPEN_BINS, vocabulary: str | None = None) -> DataFrame:
    """Encode and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(stored(piece_rows(docs, capacity, vocabulary), "pieces", BATCH_ROWS), capacity, bins)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids in order, and the bounds of the pieces in them.

    ``pieces`` has the ids (``piece_rows(..., with_ids=True)``). A sequence has a bounded number of ids.
    """
    rows = packed.join(pieces.select("doc_id", "piece", "ids_crc32", "ids"), ["doc_id", "piece", "ids_crc32"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"], p["length"], p["doc_id"])).alias("bounds"))
