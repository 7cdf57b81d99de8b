"""Operator 4. Language identification by a string kernel.

A text is the set of its byte n-grams of several lengths (a blended spectrum), presence only, so that long texts and
repeated lines weigh no more than others. The kernel of two texts is the cosine of their sets. A Nyström map sends a
text to its kernel values with some landmark texts, whitened by the landmarks' own kernel matrix; on it, one
ridge regression for each language, solved in closed form, tells the language from the rest. A batch of texts is
scored by matrix products: presence x landmarks, then x weights, which are folded into one matrix.

n-grams are hashed to a fixed number of features. Training takes a bounded sample of whole texts for each language,
those whose document ids hash lowest; scoring takes every whole text.

Edge cases: null text or text without a letter: ``und``, score 0. No labelled text at all: every text is ``und``.
Repeated rows are scored each. Very long texts are taken whole, their bytes being in memory. Ties go to the language that
comes first by name. Other columns stay, but for ``lang_pred`` and ``lang_score``, which give way to the results, and
``lang_letters``, which is dropped. Empty table: no rows. The model is fitted on the driver while the result is planned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.wordarrays import LOWER, buffers, runs
from lectern.llm.workers import tidy

UNKNOWN = "und"
LENGTHS = (1, 2, 3)
FEATURES = 1 << 12
#: Texts to train with, for each language at most, in all, and for each language at least; landmarks for each language and in all.
SAMPLE, SAMPLE_ALL, SAMPLE_LEAST, LANDMARKS, LANDMARKS_ALL = 300, 6000, 20, 40, 512
RIDGE = 1e-3
#: Rows of presence at a time.
ROWS = 256


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


def _marks(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Hashed n-grams of each length at every place of the bytes."""
    data = LOWER[data].astype(np.uint32)
    out, h = [], np.zeros(len(data), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        m = max(0, len(data) - n + 1)
        h = h[:m] * np.uint32(257) + data[n - 1 : n - 1 + m]
        if n in LENGTHS:
            g = (h + np.uint32(n)) * np.uint32(2654435761)
            g ^= g >> np.uint32(15)
            out.append((n, (g * np.uint32(2246822519)) >> np.uint32(20)))
    return out


def presence(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row for each text, of length 1: which n-grams it has."""
    rows = len(bounds) - 1
    x = np.zeros(rows * FEATURES, np.float32)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(rows, dtype=np.int32) * FEATURES, sizes)
    for n, marks in _marks(data):
        ahead = owner[: len(marks)]
        same = ahead == owner[n - 1 :] if n > 1 else slice(None)
        x[ahead[same] + marks[same].astype(np.int32)] = 1
    x = x.reshape(rows, FEATURES)
    norm = np.sqrt(x.sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1)


def _presence_of(column: pa.Array) -> np.ndarray:
    data, bounds = buffers(column)
    parts = [presence(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in _batches(bounds)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)


def _batches(bounds: np.ndarray):
    for i, j in runs(bounds, 1 << 20):
        for k in range(i, j, ROWS):
            yield k, min(j, k + ROWS)


def train(samples: list[tuple[str, str]]) -> Model:
    """Fit to (text, language) pairs; their order decides which of them are landmarks."""
    return fit(_presence_of(pa.array([t for t, _ in samples], pa.string())), [lang for _, lang in samples])


def fit(x: np.ndarray, names: list[str]) -> Model:
    """Fit to rows of presence and their languages."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((0, FEATURES), np.float32), np.zeros((0, 0), np.float32))
    label = np.array([languages.index(lang) for lang in names])
    each = max(1, min(LANDMARKS, LANDMARKS_ALL // len(languages)))
    chosen = np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(languages))])
    landmarks = x[chosen]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * max(values[-1], 1e-12)
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = (x @ landmarks.T).astype(np.float64) @ whiten
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, 0.0)
    share = 1 / np.bincount(label, minlength=len(languages))[label][:, None]  # each language weighs the same
    share *= len(label) / len(languages)
    solved = np.linalg.solve(z.T @ (z * share) + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ (y * share))
    weights = np.concatenate([whiten @ solved[:-1], solved[-1:]])
    return Model(languages, np.ascontiguousarray(landmarks.T), weights.astype(np.float32))


def predict(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language of each text and its score, the regression's value held to 0 .. 1."""
    best, score = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1)
    for i, j in _batches(bounds):
        kernel = presence(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) @ model.landmarks
        margin = kernel @ model.weights[:-1] + model.weights[-1]
        best[i:j] = margin.argmax(axis=1)
        score[i:j] = np.clip(margin.max(axis=1), 0, 1)
    return best, score


def sample(docs: DataFrame, learn, each: int = SAMPLE, total: int = SAMPLE_ALL) -> tuple[np.ndarray, list[str]]:
    """Presence of whole texts to train with, and their languages: of each those with the lowest hashes of their ids.

    Counts of languages come first, so that only rows below a hash that leaves about as many as are wanted are
    ranked. Every language is learned: the more there are, the fewer texts of each, down to ``SAMPLE_LEAST``. Presence is
    taken where the texts are, so the driver gets 512 bytes for each, however long.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)).alias("h"), F.col("doc_id").cast("string").alias("id"))
    counts = [tuple(row) for row in known.groupBy("lang").count().collect()]  # a number for each language
    if not counts:
        return np.zeros((0, FEATURES), np.float32), []
    each = min(each, max(SAMPLE_LEAST, total // len(counts)))
    limits = docs.sparkSession.createDataFrame([(lang, min(1 << 30, int((1 << 30) * 2 * each / n) + 1)) for lang, n in counts], "lang string, limit long")
    order = Window.partitionBy("lang").orderBy("h", "id", "text")
    low = known.join(F.broadcast(limits), "lang").filter(F.col("h") < F.col("limit")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each)

    def mark(batches):
        for batch in batches:
            bits = np.packbits(_presence_of(batch.column(2)) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "rank", "bits"])

    rows = low.select("lang", "rank", "text").mapInArrow(tidy(mark), "lang string, rank int, bits binary").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(-1, FEATURES // 8)
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1), rows.column("lang").to_pylist()


def held_out(doc_id) -> F.Column:
    """A third of the documents by their ids is not learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def identify(docs: DataFrame, learn=None) -> DataFrame:
    """docs with lang_pred and lang_score; trained on those of its rows that ``learn`` allows."""
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    model = fit(*sample(docs, learn))
    clash = {"lang_pred", "lang_score", "lang_letters"} & set(docs.columns)
    docs = docs.drop(*clash) if clash else docs
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lang_letters")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def score(batches):
        model = sent.value
        for batch in batches:
            n = batch.num_rows
            seen = np.array(batch.column(len(names)).to_pylist(), dtype=bool)
            best, value = [UNKNOWN] * n, np.zeros(n)
            if model.languages and n:
                data, bounds = buffers(batch.column(at))
                index, value = predict(model, data, bounds)
                best = [model.languages[k] if s else UNKNOWN for k, s in zip(index.tolist(), seen.tolist(), strict=True)]
                value = np.where(seen, value, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(value, pa.float64())], [*names, "lang_pred", "lang_score"])

    schema = docs.limit(0).withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema
    return docs.select("*", letters).mapInArrow(tidy(score), schema)
