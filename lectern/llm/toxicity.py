"""Operator 2. Toxicity by a convolutional text classifier.

Words (lower-cased runs of ASCII digits, letters and all code points above 127) and their first four, five and six
characters, which inflected forms share, are hashed to rows of an embedding table; a word is their sum. Filters of several widths slide over a text; each keeps its largest value in the text, and a logistic unit
joins them. All parts are trained together in numpy by Adam on a bounded sample of labelled whole texts. Scores are
calibrated on texts that the training did not see, and a threshold is then found for each language; languages only
set thresholds, never scores.

For scoring, the table is multiplied with every filter's weights once, so that a convolution is a sum of rows.

Edge cases: null, empty and wordless texts get the score of a text without words, from the unit's bias. Without labels of both
kinds the score is their share (0 if there are none). A score of exactly 0.3 is predicted toxic. Repeated rows are scored
each. Very long texts are scored whole, a few MB of words at a time being in memory. Other columns stay, but for
``toxicity`` and ``toxic_in_language``, which give way to the results. Empty table: no rows. The model is trained on the
driver while the result is planned, in a time that does not grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.wordarrays import ALNUM, Words, buffers, mix, runs, split_words
from lectern.llm.workers import tidy

BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 4
#: Characters of a word that are hashed; 0 is the whole word.
PREFIXES = (0, 4, 5, 6)
BLANK = np.zeros((max(WIDTHS) - 1, len(PREFIXES)), np.int32)
#: Labelled texts of each kind at most, passes over them, texts of one step, and words at a time.
SAMPLE, EPOCHS, STEP_TEXTS = 2500, 8, 32
#: Bytes of text that go to the driver to be learned from, about.
SAMPLE_BYTES = 64 << 20
CUT = 0.3
SEED = 20240817


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def lookup(self) -> np.ndarray:
        """The table times the weights of each place of each filter, side by side."""
        return np.concatenate([self.table @ f[k] for f in self.filters for k in range(len(f))], axis=1).astype(np.float32)


def _prefix_ends(words: Words, n: int) -> np.ndarray:
    """Where the first n characters of each word end."""
    chars = np.flatnonzero((words.data & 0xC0) != 0x80)
    at = np.searchsorted(chars, words.starts) + n
    return np.minimum(np.where(at < len(chars), chars[np.minimum(at, len(chars) - 1)], len(words.data)), words.ends)


def buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and prefixes of all texts of a column in a row, and the bounds of the texts."""
    data, bounds = buffers(column)
    ids, offsets = [], [np.zeros(1, np.int64)]
    total = 0
    for i, j in runs(bounds):
        words = split_words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], ALNUM)
        part = np.zeros((len(words.starts), len(PREFIXES)), np.int32)
        for k, n in enumerate(PREFIXES if len(words.starts) else ()):
            cut = replace(words, ends=_prefix_ends(words, n)) if n else words
            part[:, k] = mix(cut.hashes() + np.uint64(n)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        ids.append(part)
        offsets.append(words.offsets[1:] + total)
        total += len(words.starts)
    return np.concatenate(ids) if ids else np.zeros((0, len(PREFIXES)), np.int32), np.concatenate(offsets)


def pooled(lookup: np.ndarray, bias: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest value of each filter in each text; 0 at least. Blanks follow a text, so filters stay within it."""
    pad, counts = len(BLANK), np.diff(offsets)
    out = np.zeros((len(counts), len(bias)), np.float32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = offsets[:-1] + pad * np.arange(len(counts))
    rows = np.zeros((len(ids) + pad * len(counts) + 1, lookup.shape[1]), np.float32)
    rows[np.arange(len(ids)) + np.repeat(pad * np.arange(len(counts)), counts)] = sum(lookup[ids[:, k]] for k in range(ids.shape[1]))
    edges = np.empty(2 * len(full), np.int64)
    edges[0::2], edges[1::2] = starts[full], starts[full] + counts[full]
    at = 0
    for w, width in enumerate(WIDTHS):
        n = len(rows) - pad
        value = rows[:n, at : at + FILTERS].copy()
        for k in range(1, width):
            value += rows[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
        top = np.maximum.reduceat(value, edges, axis=0)[0::2]
        mine = slice(w * FILTERS, (w + 1) * FILTERS)
        out[full, mine] = np.maximum(top + bias[mine], 0)
        at += width * FILTERS
    return out


def _logit(model: Model, ids: np.ndarray, offsets: np.ndarray, lookup=None) -> np.ndarray:
    lookup = model.lookup() if lookup is None else lookup
    out = np.zeros(len(offsets) - 1, np.float32)
    for i, j in runs(offsets, 1 << 17):  # so many words at a time bound the memory
        part = pooled(lookup, model.bias, ids[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out[i:j] = part @ model.out + model.out_bias
    return out


def score(model: Model, ids: np.ndarray, offsets: np.ndarray, lookup=None) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(offsets) - 1, model.constant)
    a, b = model.scale
    return 1 / (1 + np.exp(-np.clip(a * _logit(model, ids, offsets, lookup).astype(np.float64) + b, -30, 30)))


def _fit(ids, offsets, label, weight, docs, epochs=EPOCHS) -> Model:
    """Adam over whole texts. The table starts from how unevenly each bucket falls on the two kinds of texts."""
    rng = np.random.default_rng(SEED)
    seen = np.zeros((2, BUCKETS))
    total = np.zeros(2)
    for d in docs:
        k = int(label[d])
        seen[k, np.unique(ids[offsets[d] : offsets[d + 1]])] += weight[d]
        total[k] += weight[d]
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    spread = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    table = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    table[:, 0] = np.clip(odds / spread, -6, 6) / 3
    table[0] = 0
    filters = [rng.normal(0, 0.15, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.3
    out = np.full(FILTERS * len(WIDTHS), 0.5, np.float32)
    share = max(1e-3, min(0.999, total[1] / max(total.sum(), 1e-9)))
    model = Model(table, filters, np.full(len(out), -0.5, np.float32), out, float(np.log(share / (1 - share))))
    params = [model.table, *model.filters, model.bias, model.out, np.array([model.out_bias], np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, rate = 0, 0.01
    docs = np.array(docs)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(docs), max(1, len(docs) // STEP_TEXTS)):
            grads = [np.zeros_like(p) for p in params[1:]]
            rows, row_grads = [], []
            hidden = np.zeros((len(at), len(out)), np.float32)
            places = np.full((len(at), len(out)), -1)
            for r, d in enumerate(at):
                words = ids[offsets[d] : offsets[d + 1]]
                if not len(words):
                    continue
                x = model.table[np.concatenate([words, BLANK])].sum(axis=1)
                for w, f in enumerate(model.filters):
                    value = sum(x[k : k + len(words)] @ f[k] for k in range(len(f))) + model.bias[w * FILTERS : (w + 1) * FILTERS]
                    best = value.argmax(axis=0)
                    top = value[best, np.arange(FILTERS)]
                    hidden[r, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top, 0)
                    places[r, w * FILTERS : (w + 1) * FILTERS] = np.where(top > 0, best, -1)
            p = 1 / (1 + np.exp(-(hidden @ model.out + params[-1][0])))
            e = ((p - label[at]) * weight[at] / len(at)).astype(np.float32)
            grads[-2] += hidden.T @ e + 1e-4 * model.out
            grads[-1] += e.sum()
            back = e[:, None] * model.out * (places >= 0)
            grads[-3] += back.sum(axis=0)
            for r, d in enumerate(at):
                words = np.concatenate([ids[offsets[d] : offsets[d + 1]], BLANK])
                for w, f in enumerate(model.filters):
                    for j in range(FILTERS):
                        g = back[r, w * FILTERS + j]
                        if g:
                            span = words[places[r, w * FILTERS + j] :][: len(f)]
                            grads[w][:, :, j] += g * model.table[span].sum(axis=1)
                            rows.append(span.reshape(-1))
                            row_grads.append(np.repeat(g * f[:, :, j], span.shape[1], axis=0))
            step += 1
            for k in range(1, len(params)):
                m[k] = 0.9 * m[k] + 0.1 * grads[k - 1]
                v[k] = 0.999 * v[k] + 0.001 * grads[k - 1] ** 2
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if rows:  # only rows in use move
                index, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                g = np.zeros((len(index), SIZE), np.float32)
                np.add.at(g, inverse, np.concatenate(row_grads))
                m[0][index] = 0.9 * m[0][index] + 0.1 * g
                v[0][index] = 0.999 * v[0][index] + 0.001 * g**2
                model.table[index] -= 0.2 * rate * m[0][index] / (np.sqrt(v[0][index]) + 1e-6)
                model.table[0] = 0
    model.out_bias = float(params[-1][0])
    return model


def _calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the logits, by Newton's method with a light pull to (1, 0)."""
    theta = np.array([1.0, 0.0])
    x = np.stack([logit.astype(np.float64), np.ones(len(logit))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (p - label)) + (theta - [1.0, 0.0]) * 0.5
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        theta -= np.linalg.solve(h, g)
    return float(max(theta[0], 0.05)), float(theta[1])


def train(texts: list[str | None], label: np.ndarray, weight: np.ndarray, languages: list[str | None]) -> tuple[Model, dict[str | None, float]]:
    """A model of all texts, calibrated by two-fold scores, and a threshold for each language."""
    label, weight = np.asarray(label, np.float64), np.asarray(weight, np.float64)
    if len(set(label.tolist())) < 2:
        none = Model(np.zeros((1, SIZE)), [], np.zeros(0), np.zeros(0), 0.0, constant=float(label.mean()) if len(label) else 0.0)
        return none, {}
    ids, offsets = buckets(pa.array(texts, pa.string()))
    everything = np.arange(len(label))
    logit = np.zeros(len(label))
    for fold in (0, 1):
        kept = np.concatenate([np.flatnonzero(label == k)[fold::2] for k in (0, 1)])
        if len(set(label[kept].tolist())) < 2:
            continue
        part = _fit(ids, offsets, label, weight, kept)
        logit_all = _logit(part, ids, offsets)
        other = np.setdiff1d(everything, kept)
        logit[other] = logit_all[other]
    model = _fit(ids, offsets, label, weight, everything)
    model.scale = _calibrate(logit, label, weight)
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * logit + model.scale[1], -30, 30)))
    thresholds = {}
    for lang in sorted({x for x in languages if x is not None}):
        mine = np.array([x == lang for x in languages])
        if label[mine].sum() < 10:
            continue
        grid = np.linspace(0.05, 0.95, 91)
        good = [(weight * mine * (p >= t) * label).sum() for t in grid]
        said = [(weight * mine * (p >= t)).sum() for t in grid]
        real = (weight * mine * label).sum()
        thresholds[lang] = float(grid[int(np.argmax([2 * g / max(s + real, 1e-9) for g, s in zip(good, said, strict=True)]))])
    return model, thresholds


def held_out(doc_id) -> F.Column:
    """A quarter of the documents by their ids is not learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, learn, each: int = SAMPLE) -> list:
    """At most about ``each`` labelled texts of either kind, those with the lowest hashes of their ids, and at most about
    ``SAMPLE_BYTES`` of text in all; only texts over a sixteenth of that are never learned from.

    Returns rows of text, lang, toxic and weight; weights undo that the kinds are sampled at different rates.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(learn(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return []
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    keep = F.lit(False)
    weight = F.lit(0.0)
    for kind, n in counts.items():
        share = min(1.0, each / n)
        keep = keep | ((F.col("toxic") == kind) & (h < int(share * (1 << 30))))
        weight = F.when(F.col("toxic") == kind, 1 / share).otherwise(weight)
    # At most about 2 x each ids: a bounded list, which makes the join with the documents a filter.
    chosen = known.filter(keep).withColumn("weight", weight)
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES // 16)
    # Ids may be repeated and texts very long: a random part of both kinds, if it would be too many bytes.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * 0.9 * SAMPLE_BYTES / size))
    return rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text").select("text", "lang", "toxic", "weight").toArrow().to_pylist()


def score_documents(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_in_language, the score held against the language's own threshold."""
    learn = (lambda c: ~held_out(c)) if learn is None else learn
    rows = sample(docs, labels, learn)
    model, thresholds = train([r["text"] for r in rows], [r["toxic"] for r in rows], [r["weight"] for r in rows], [r["lang"] for r in rows])
    del rows
    docs = docs.drop(*({"toxicity", "toxic_in_language"} & set(docs.columns)))
    sent = docs.sparkSession.sparkContext.broadcast((model, None if model.constant is not None else model.lookup()))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        model, lookup = sent.value
        for batch in batches:
            _, bounds = buffers(batch.column(at))
            for i, j in runs(bounds, 1 << 20):
                ids, offsets = buckets(batch.column(at).slice(i, j - i))
                value = score(model, ids, offsets, lookup)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(value, pa.float64())], [*names, "toxicity"])

    scored = docs.mapInArrow(tidy(run), docs.limit(0).withColumn("toxicity", F.lit(0.0)).schema)
    limit = F.lit(CUT)
    for lang, t in thresholds.items():
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    return scored.withColumn("toxic_in_language", F.col("toxicity") >= limit)
