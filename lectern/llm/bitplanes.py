"""Operator 7. Token ids in files of compressed planes.

Ids are cut into blocks of a fixed number. A block is transposed: plane k holds byte k (or bit k) of every id, and
each plane is compressed by zstandard on its own, so that the nearly constant high planes cost next to nothing.
Planes above the highest one in use are left out. Layout of a file, all numbers little-endian::

    magic                          8 bytes
    planes of block 0, 1, ...      zstandard frames
    index                          zstandard frame of int64: kind of planes, ids in a block, then for each block its
                                   offset, its number of ids, its number of planes and their sizes
    documents                      zstandard frame of int64: document ids, then their numbers of ids
    offset of index, size of index, size of documents, number of documents, number of blocks    5 x int64

Files are written below a folder shared by all machines, one for each range of doc_id. Every attempt of a task
writes a file under a name of its own, and only the manifest of the attempts that Spark accepted names the files to
read, so a lost executor leaves at most a file that nobody reads.

Edge cases: null and empty text: only the end id. Repeated doc_ids: kept, ordered by text. Empty table: no file.
Other columns are ignored. Long texts are encoded whole; memory is bounded by one text and one block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.pieces import END_ID, TEXTS, encoder, forget, text_runs
from lectern.llm.workers import tidy

MAGIC = b"LPLANES1"
BLOCK_IDS = 1 << 16
#: Bytes of text that go to one file, about.
FILE_BYTES = 16 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Transpose unsigned 32-bit ids into byte planes or bit planes, without the empty ones on top."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    most = int(ids.max()) if len(ids) else 0
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((most.bit_length() + 7) // 8)]
    rows = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(rows[:, k], bitorder="little").tobytes() for k in range(most.bit_length())]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The inverse of ``to_planes``."""
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
        return raw.reshape(-1).view("<u4").copy()
    rows = np.zeros((n, 32), np.uint8)
    for k, plane in enumerate(planes):
        rows[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4").copy()


class PlaneWriter:
    """Writes one file; ``add`` takes the ids of a document as little-endian bytes."""

    def __init__(self, sink, bits: bool = False, block: int = BLOCK_IDS, level: int = 1):
        import zstandard

        self.sink, self.bits, self.block = sink, bits, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.docs, self.lengths, self.blocks = len(MAGIC), [int(bits), block], [], [], 0
        self.held, self.size = [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids) // 4
        if self.size >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        i = 0
        while len(ids) - i >= self.block or last and i < len(ids):
            part = ids[i : i + self.block]
            planes = [self.zip.compress(p) for p in to_planes(part, self.bits)]
            self.index += [self.at, len(part), len(planes), *map(len, planes)]
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
            self.blocks += 1
            i += self.block
        self.held, self.size = [ids[i:].tobytes()], max(0, len(ids) - i)

    def close(self) -> None:
        self._flush(True)
        index = self.zip.compress(np.array(self.index, "<i8").tobytes())
        docs = self.zip.compress(np.array(self.docs + self.lengths, "<i8").tobytes())
        for part in (index, docs, np.array([self.at, len(index), len(docs), len(self.docs), self.blocks], "<i8").tobytes()):
            self.sink.write(part)
        self.sink.close()


class PlaneReader:
    """Reads a file by its index: any block, any document, or all documents in turn."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of planes")
        at, n_index, n_docs, docs, blocks = np.frombuffer(self._read(size - 40, 40), "<i8").tolist()
        index = np.frombuffer(self.unzip.decompress(self._read(at, n_index)), "<i8").tolist()
        table = np.frombuffer(self.unzip.decompress(self._read(at + n_index, n_docs)), "<i8")
        self.docs, self.lengths = table[:docs], table[docs:]
        self.bits, self.block_ids = bool(index[0]), index[1]
        self.blocks, i = [], 2
        for _ in range(blocks):
            offset, n, k = index[i : i + 3]
            self.blocks.append((offset, n, index[i + 3 : i + 3 + k]))
            i += 3 + k

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> np.ndarray:
        offset, n, sizes = self.blocks[i]
        raw, planes = self._read(offset, sum(sizes)), []
        for s in sizes:
            planes.append(self.unzip.decompress(raw[:s]))
            raw = raw[s:]
        return from_planes(planes, n, self.bits)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Some ids by their place in the file; only the blocks they lie in are read."""
        parts, end = [], start + n
        while start < end:
            i, j = divmod(start, self.block_ids)
            part = self.block(i)[j : j + end - start]
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int, int, Iterator[bytes]]]:
        """Document id, number of ids, and the ids in parts; each block is decoded once."""
        held, i = np.zeros(0, "<u4"), 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            parts, left = [], n
            while left:
                if not len(held):
                    held, i = self.block(i), i + 1
                parts.append(held[:left].tobytes())
                left -= min(left, len(held))
                held = held[len(parts[-1]) // 4 :]
            yield doc, n, parts


def write_ids(docs: DataFrame, folder: str, bits: bool = False, vocabulary: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode every text, append the end id, and write the ids in ascending doc_id order below ``folder``.

    Returns the manifest: one row for each file with its path, first document, and numbers of documents and ids.
    The rows are made when the manifest is computed, so store it before reading from it. A file holds about
    ``FILE_BYTES`` of text, whatever the table's size, which is asked while the result is planned.
    """

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, first = f"{base}/{uuid.uuid4().hex}.planes", None, None
        total = 0
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), TEXTS):
                texts = column.slice(i, TEXTS).to_pylist()
                for span in text_runs(texts):
                    for doc, raw in zip(ids[i:][span], encoder(vocabulary).encode(texts[span]), strict=True):
                        if out is None:
                            out, first = PlaneWriter(store.open_output_stream(name), bits), doc
                        out.add(doc, raw + END_ID.to_bytes(4, "little"))
                        total += len(raw) // 4 + 1
        if out is not None:
            out.close()
            uri = folder.rstrip("/") + "/" + name.rpartition("/")[2]
            yield pa.RecordBatch.from_pylist([{"path": uri, "first_doc": first, "n_docs": len(out.docs), "n_ids": total}], schema=pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(write, forget), "path string, first_doc long, n_docs long, n_ids long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row per document from the files of a stored manifest: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as source:
                    docs, starts, counts, sums, at = [], [], [], [], row["before"]
                    for doc, n, parts in PlaneReader(source).documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part, crc)
                        docs.append(doc)
                        starts.append(at)
                        counts.append(n)
                        sums.append(crc)
                        at += n
                for i in range(0, len(docs), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000], pa.int64()) for x in (docs, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file: few enough for one task at any size.
    order = Window.orderBy("first_doc", "path")
    files = manifest.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids")).select("path", "before")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
