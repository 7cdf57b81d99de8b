"""Operator 8. Language-model scores from an Elias-Fano n-gram trie.

The model is a trie of n-grams up to ``ORDER``, smoothed by interpolated absolute discounting: an n-gram gives
``(c(u..w) - D) / c(u..)``, and what a context does not give away goes to the n-gram that is a word shorter, down to the
words' own probabilities, which are discounted likewise in favour of the one unknown word. A context that was not
learned gives all to the shorter one. Probabilities are quantised downwards, and what a context's children leave over is
taken from the quantised ones, so every context's probabilities sum to one. Nothing is pruned unless ``least`` says so;
counts are of all training documents.

Neither the vocabulary nor the trie need fit one machine. Documents are read in blocks. A block asks for each distinct
n-gram and word once, with its count in the block's training documents; requests are dealt to shards. An n-gram
belongs to the shard of its first two words, so that a frequent first word does not meet in one, and is sent as nested
levels: children below their parent. A shard sums the counts, writes its trie to the shared folder, opens it by memory
map where the folder is local, and answers by walking down from the first word, a successor search among the children
of each node; then the file is deleted, unless ``keep`` names a folder for the model. Answers are gathered for each block in one file of the shared folder, named by the block, and the
blocks are read once more and scored. Shards hold about ``SHARD_BYTES`` of text each, whatever the input's size.

In the level below the first words the trie holds discounted counts, as a first word's successors are spread over
shards and only the words' own shard knows its total; below that it holds probabilities.

First words are known by 63 bits of their hash, words of the vocabulary by 64, second words by 40 among a first word's
children, where a million siblings have a pair alike with a chance of about a half, and others by 32 among the children
of a node, where that takes 65,000 siblings.

The table must be read the same way each time: a scan of files, or a stored table. Requests and answers carry a
checksum of their block's ids, and a different block is an error, never a wrong score. Jobs run while the result is planned.

Edge cases: null and empty texts are the end alone. Without training documents all words are unknown and have
probability 1. Repeated rows are each counted and scored. A very long text is a block of its own. Columns other than
doc_id and text are not read. Empty table: no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blobs import dealt, pack, pack_sorted, unpack, unpack_sorted
from lectern.llm.eliasfano import Trie
from lectern.llm.storage import drop_folder, shared_folder, stored
from lectern.llm.wordarrays import SOLID, buffers, mix, split_words
from lectern.llm.workers import tidy, tidy_group

BLOCK_BYTES, SHARD_BYTES = 4 << 20, 4 << 20
#: Rows that a Python worker gets at once while requests are made; blocks do not depend on it.
BATCH_ROWS = 2_000
ORDER = 3
DISCOUNT, WORD_DISCOUNT = 0.75, 0.7
#: Ranges of first words; each range is spread by second words.
RANGES = 32


def bits(level: int) -> int:
    """Bits of a word among the children of a node: first words have by far the most."""
    return 32 if level else 40


def short(words: np.ndarray, level: int) -> np.ndarray:
    return words.astype(np.uint32) if level else words & np.uint64((1 << bits(0)) - 1)


START = np.uint64(0x5851F42D4C957F2D)
END = np.uint64(0x14057B7EF767814F)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, in a row, and the bounds of the texts."""
    words = split_words(data, bounds, SOLID)
    counts = words.counts()
    offsets = words.offsets + np.arange(len(counts) + 1)
    out = np.full(len(words.starts) + len(counts), END, np.uint64)
    out[np.arange(len(words.starts)) + np.repeat(np.arange(len(counts)), counts)] = words.hashes()
    return out, offsets


def word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shard(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    spread = max(1, shards // RANGES)
    ranges = max(1, shards // spread)
    return word_shard(first, ranges) * spread + (mix(second) % np.uint64(spread)).astype(np.int64)


def _runs_of_documents(batches):
    """Consecutive rows of one partition, as many as have ``BLOCK_BYTES`` of text at most, or one, however they are batched."""
    pending, held = [], 0
    for batch in batches:
        bounds = buffers(batch.column(1))[1]
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(bounds, bounds[i] + BLOCK_BYTES - held, side="right")) - 1
            j = min(max(j, i if pending else i + 1), batch.num_rows)
            if j > i:
                pending.append(batch.slice(i, j - i))
                held += int(bounds[j] - bounds[i])
                i = j
            if i < batch.num_rows:
                yield pa.Table.from_batches(pending).combine_chunks()
                pending, held = [], 0
    if pending:
        yield pa.Table.from_batches(pending).combine_chunks()


def _blocks(batches):
    """Blocks of one partition: number, checksum, documents, training flags, tokens, offsets."""
    task = TaskContext.get().partitionId()
    for number, docs in enumerate(_runs_of_documents(batches)):
        part = docs.to_batches()[0]
        words, offsets = tokens(*buffers(part.column(1)))
        check = zlib.crc32("\n".join(part.column(0).cast(pa.string()).fill_null("").to_pylist()).encode())
        yield task << 32 | number, check, part, np.array(part.column(2).to_pylist(), bool), words, offsets


def _distinct(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts among trained tokens, and the place of each token's key."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place[trained], minlength=len(distinct)).astype(np.uint32), place


class Grams:
    """Distinct n-grams of a block. ``words`` are the distinct words' hashes, the start among them. Of level k, counted
    from 0 for bigrams: ``parent`` is the place in the level above (for bigrams a word), ``word`` a place in words,
    ``count`` that in training documents, ``place`` where each token's n-gram is (-1 where its document has none)."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, trained: np.ndarray, order: int):
        self.words, token = np.unique(np.concatenate([words, np.full(1, START)]), return_inverse=True)
        token, start = token[:-1], int(token[-1])
        self.token, size = token, len(self.words)
        self.before = np.empty(len(words), np.int64)
        self.before[1:] = token[:-1]
        self.before[offsets[:-1]] = start
        since = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
        self.parent, self.word, self.count, self.place = [], [], [], []
        above = self.before
        for n in range(2, order + 1):
            valid = np.flatnonzero(since >= n - 2)
            distinct, count, place = _distinct(above[valid] * size + token[valid], trained[valid])
            everywhere = np.full(len(words), -1)
            everywhere[valid] = place
            self.parent.append(distinct // size)
            self.word.append(distinct % size)
            self.count.append(count)
            self.place.append(everywhere)
            above = np.concatenate([[-1], everywhere[:-1]])

    def shards(self, shards: int) -> list[np.ndarray]:
        """The shard of each n-gram, by levels."""
        found = [pair_shard(self.words[self.parent[0]], self.words[self.word[0]], shards)]
        for parent in self.parent[1:]:
            found.append(found[-1][parent])
        return found


WORD_REQUEST = "shard long, block long, check long, keys binary, counts binary"
_WORD_REQUEST = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("check", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
GRAM_REQUEST = "shard long, block long, check long, first binary, words array<binary>, counts array<binary>, children array<binary>"
_GRAM_REQUEST = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("check", pa.int64()), ("first", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())), ("children", pa.list_(pa.binary()))])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _word_requests(docs: DataFrame, shards: int) -> DataFrame:
    def ask(batches):
        for block, check, _, train, words, offsets in _blocks(batches):
            # The start counts as a context once for each training document.
            trained = np.concatenate([np.repeat(train, np.diff(offsets)), train])
            keys, counts, _ = _distinct(np.concatenate([words, np.full(len(train), START)]), trained)
            yield _batch([{"shard": s, "block": block, "check": check, "keys": pack_sorted(keys[at]), "counts": pack(counts[at])} for s, at in dealt(word_shard(keys, shards))], _WORD_REQUEST)

    return docs.mapInArrow(tidy(ask), WORD_REQUEST)


def _gram_requests(docs: DataFrame, shards: int, order: int) -> DataFrame:
    def ask(batches):
        for block, check, _, train, words, offsets in _blocks(batches):
            grams = Grams(words, offsets, np.repeat(train, np.diff(offsets)), order)
            levels = [dict(dealt(s)) for s in grams.shards(shards)]
            children = [np.bincount(p, minlength=len(w)).astype(np.uint32) for p, w in zip(grams.parent[1:], grams.word, strict=False)]
            rows = []
            for s, at in levels[0].items():
                parts = [level.get(s, at[:0]) for level in levels]
                rows.append({
                    "shard": s, "block": block, "check": check, "first": pack_sorted(grams.words[grams.parent[0][at]]),
                    "words": [pack(short(grams.words[grams.word[k][p]], k)) for k, p in enumerate(parts)],
                    "counts": [pack(grams.count[k][p]) for k, p in enumerate(parts)],
                    "children": [pack(children[k][p]) for k, p in enumerate(parts[:-1])],
                })
            yield _batch(rows, _GRAM_REQUEST)

    return docs.mapInArrow(tidy(ask), GRAM_REQUEST)


def _summed(requests: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys that training documents hold, and their counts."""
    if not requests:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k[c > 0] for k, c in requests])
    counts = np.concatenate([c[c > 0] for _, c in requests])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _kind(level: int):
    return np.uint32 if level else np.uint64


def _deleted(folder: str, path: str) -> None:
    from pyarrow import fs

    fs.FileSystem.from_uri(folder)[0].delete_file(path)


def _opened(folder: str, raw: bytes) -> tuple[Trie, str]:
    """Write a trie to the shared folder and open it there; also its path."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{uuid.uuid4().hex}.trie"
    store.create_dir(base, recursive=True)
    with store.open_output_stream(path) as out:
        out.write(raw)
    if isinstance(store, fs.LocalFileSystem):
        return Trie.view(np.memmap(path, np.uint8, "r")), path
    with store.open_input_file(path) as source:
        return Trie.view(source.read()), path


ANSWER = "kind int, shard long, block long, check long, parts array<binary>"
_ANSWER = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("check", pa.int64()), ("parts", pa.list_(pa.binary()))])


def _gram_answers(requests: DataFrame, folder: str, shards: int, least: int, keep: str | None) -> DataFrame:
    """Kind 2: of a block's n-grams of a shard, level by level, which are in the trie, the codes of those, what their
    children leave over, and the codes' values. Kind 0: for a shard of words, first words and the sum of what they give away here."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        order = len(rows[0]["words"])
        # Levels of all requests in one: a distinct key is the parent's number and the word.
        first, above = np.unique(np.concatenate([unpack_sorted(r["first"]) for r in rows]), return_inverse=True)
        nodes, places = [], []
        for k in range(order):
            word = np.concatenate([unpack(r["words"][k], _kind(k)) for r in rows]).astype(np.uint64)
            count = np.concatenate([unpack(r["counts"][k], np.uint32) for r in rows])
            distinct, place = np.unique(above.astype(np.uint64) << np.uint64(bits(k)) | word, return_inverse=True)
            nodes.append(((distinct >> np.uint64(bits(k))).astype(np.int64), distinct & np.uint64((1 << bits(k)) - 1), np.bincount(place, count, len(distinct))))
            places.append(place)
            if k + 1 < order:
                above = np.repeat(place, np.concatenate([unpack(r["children"][k], np.uint32) for r in rows]))
        # What training documents hold of it is the trie; numbers of nodes become ranks among those kept.
        learned, rank, whole = [], None, None
        roots = np.unique(nodes[0][0][nodes[0][2] >= least])
        for k, (parent, word, count) in enumerate(nodes):
            kept = np.flatnonzero(count >= least)
            up = np.searchsorted(roots, parent[kept]) if k == 0 else rank[parent[kept]]
            learned.append((up, word[kept], count[kept] - DISCOUNT if k == 0 else (count[kept] - DISCOUNT) / whole[parent[kept]]))
            rank, whole = np.cumsum(count >= least) - 1, count
        raw = Trie.of(first[roots] >> np.uint64(1), learned, [bits(k) for k in range(order)]).to_bytes()
        trie, path = _opened(keep or folder, raw)
        # The walk: each distinct n-gram that was asked for, from its first word down.
        found, at = [], trie.root(first >> np.uint64(1))
        for k, (parent, word, _) in enumerate(nodes):
            at = trie.child(k, at[parent], word)
            found.append(at)
        out, sizes = [], [np.cumsum([0, *(len(unpack(r["words"][k], _kind(k))) for r in rows)]) for k in range(order)]
        for i, row in enumerate(rows):
            parts = []
            for k, (_, _, codes, book, backoff) in enumerate(trie.levels):
                node = found[k][places[k][sizes[k][i] : sizes[k][i + 1]]]
                hit = node >= 0
                parts += [pack(np.packbits(hit)), pack(codes[node[hit]]), pack(backoff[node[hit]]) if k + 1 < order else b"", book.tobytes()]
            out.append({"kind": 2, "shard": row["shard"], "block": row["block"], "check": row["check"], "parts": parts})
        if len(roots):
            given = np.bincount(learned[0][0], trie.levels[0][3][trie.levels[0][2]].astype(np.float64), len(roots))
            names = first[roots]
            out += [{"kind": 0, "shard": s, "block": -1, "check": 0, "parts": [pack_sorted(names[at]), pack(given[at])]} for s, at in dealt(word_shard(names, shards))]
        if not keep:
            del trie
            _deleted(folder, path)
        return pa.Table.from_pylist(out, _ANSWER)

    return requests.groupBy("shard").applyInArrow(tidy_group(answer), ANSWER)


def _word_answers(requests: DataFrame, masses: DataFrame) -> DataFrame:
    """Kind 1: counts of a block's words of a shard and what they give away as contexts. Kind 3: the shard's number of
    different words and of words."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [(unpack_sorted(r["keys"]), unpack(r["counts"], np.uint32)) for r in rows if r["block"] >= 0]
        given = [(unpack_sorted(r["keys"]), unpack(r["counts"], np.float64)) for r in rows if r["block"] < 0]
        keys, counts = _summed(asked)
        contexts = np.concatenate([k for k, _ in given]) if given else np.zeros(0, np.uint64)
        distinct, place = np.unique(contexts, return_inverse=True)
        mass = np.bincount(place, np.concatenate([v for _, v in given]) if given else None, len(distinct))
        out = []
        for row, (k, _) in zip([r for r in rows if r["block"] >= 0], asked, strict=True):
            count, share = np.zeros(len(k), np.int64), np.zeros(len(k))
            for names, values, into in ((keys, counts, count), (distinct, mass, share)):
                if len(names):
                    at = np.minimum(np.searchsorted(names, k), len(names) - 1)
                    into[:] = np.where(names[at] == k, values[at], 0)
            out.append({"kind": 1, "shard": row["shard"], "block": row["block"], "check": row["check"], "parts": [pack(count), pack(share.astype(np.float32))]})
        real = keys != START
        out.append({"kind": 3, "shard": rows[0]["shard"], "block": -1, "check": 0, "parts": [int(real.sum()).to_bytes(8, "big"), int(counts[real].sum()).to_bytes(8, "big")]})
        return pa.Table.from_pylist(out, _ANSWER)

    both = requests.unionByName(masses.select("shard", "block", "check", F.col("parts")[0].alias("keys"), F.col("parts")[1].alias("counts")))
    return both.groupBy("shard").applyInArrow(tidy_group(answer), ANSWER)


def _filed(answers: DataFrame, folder: str) -> int:
    """Write one file for each block with its answers; the number of blocks."""

    def write(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        block = table.column("block")[0].as_py()
        # A task that is tried again, or twice at once, writes the same file.
        name = f"{base}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(name) as out, pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        store.move(name, f"{base}/{block}.answers")
        return pa.table({"block": pa.array([block], pa.int64())})

    rows = stored(answers.filter("kind in (1, 2)").groupBy("block").applyInArrow(write, "block long"), "lm-files")
    n = rows.count()
    drop_folder(rows)
    return n


def _answers(folder: str, block: int, check: int) -> dict[tuple[int, int], list[bytes]]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{base}/{block}.answers").type != fs.FileType.File:
        raise RuntimeError("the documents were dealt to blocks differently than before")
    with store.open_input_stream(f"{base}/{block}.answers") as source:
        rows = pa.ipc.open_stream(source).read_all().to_pylist()
    if any(r["check"] != check for r in rows):
        raise RuntimeError("a block's answers are of other documents")
    return {(r["kind"], r["shard"]): r["parts"] for r in rows}


def held_out(doc_id) -> F.Column:
    """A fifth of the documents by their ids is not learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 1


SCORES = ["n_tokens", "n_known", "base_score", "score"]


def score_documents(docs: DataFrame, train, least: int = 1, order: int = ORDER, keep: str | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score. ``train`` says which rows are learned from,
    ``least`` how often an n-gram of two words or more that is kept occurs in them. ``keep`` is a folder, as a URI, where the
    shards' tries stay; else each is deleted when it has answered."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    folder = shared_folder(spark, "lm")
    found2 = stored(_gram_answers(_gram_requests(docs, shards, order), f"{folder}/tries", shards, least, keep), "lm-grams", BATCH_ROWS)
    found1 = stored(_word_answers(_word_requests(docs, shards), found2.filter("kind = 0")), "lm-words", BATCH_ROWS)
    # Two numbers from each shard, added up where they are.
    number = F.expr("transform(parts, p -> cast(conv(hex(p), 16, 10) as long))")
    totals = found1.filter("kind = 3").select(number.alias("n")).agg(F.sum(F.col("n")[0]), F.sum(F.col("n")[1])).first()
    n_different, n_words = (int(x or 0) for x in totals)
    _filed(found1.unionByName(found2), f"{folder}/answers")
    drop_folder(found1, found2)

    def score(batches):
        unknown = WORD_DISCOUNT * n_different / max(n_words, 1) / (n_different + 1) if n_words else 1.0
        for block, check, part, train, words, offsets in _blocks(batches):
            got = _answers(f"{folder}/answers", block, check)
            grams = Grams(words, offsets, np.repeat(train, np.diff(offsets)), order)
            count, mass = np.zeros(len(grams.words), np.int64), np.zeros(len(grams.words))
            for s, at in dealt(word_shard(grams.words, shards)):
                row = got.pop((1, s))
                count[at], mass[at] = unpack(row[0], np.int64), unpack(row[1], np.float32)
            value, left = [np.zeros(len(w)) for w in grams.word], [np.ones(len(w)) for w in grams.word]
            for k, where in enumerate(grams.shards(shards)):
                for s, at in dealt(where):
                    hits, codes, backoff, book = got[2, s][4 * k : 4 * k + 4]
                    hit = at[np.unpackbits(unpack(hits, np.uint8), count=len(at)).astype(bool)]
                    value[k][hit] = np.frombuffer(book, np.float32)[unpack(codes, np.uint8)]
                    if backoff:
                        left[k][hit] = unpack(backoff, np.float32)
            c = count[grams.token]
            p = np.where(c > 0, np.maximum(c - WORD_DISCOUNT, 0) / max(n_words, 1), 0) + unknown
            n_before = count[grams.before]
            rest = np.clip(1 - mass[grams.before] / np.maximum(n_before, 1), 1e-6, 1)
            p = np.where(n_before > 0, value[0][grams.place[0]] / np.maximum(n_before, 1) + rest * p, p)
            for k in range(1, order - 1):
                here = np.flatnonzero(grams.place[k] >= 0)
                p[here] = value[k][grams.place[k][here]] + np.clip(left[k - 1][grams.place[k - 1][here - 1]], 1e-6, 1) * p[here]
            base = np.log10((c + 0.5) / (n_words + 0.5 * (n_different + 1)))
            first = offsets[:-1]
            arrays = [pa.array(np.diff(offsets)), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(np.minimum(p, 1)), first))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *arrays], ["doc_id", "train", *SCORES])

    scored = docs.mapInArrow(tidy(score), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_words).cast("long"))
