"""Operator 4 with more languages than the sample has full shares for."""

from __future__ import annotations

import random

from lectern.llm import langid


def test_every_language_is_learned(spark):
    rng, rows = random.Random(4), []
    for k in range(26):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        rows += [(100 * k + i, "".join(rng.choices(letters, k=60)), f"l{k:02d}") for i in range(30 if k else 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs).collect()
    assert {r.lang_pred for r in found} == {f"l{k:02d}" for k in range(26)}
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_sample_is_bounded_by_fewer_texts_of_each(spark):
    rows = [(100 * k + i, f"text {i}", f"l{k}") for k in range(5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, names = langid.sample(docs, langid.F.lit(True), 50, 100)
    assert {lang: names.count(lang) for lang in names} == {f"l{k}": 20 for k in range(5)}
    assert x.shape == (100, langid.FEATURES)


def test_kernel_regression_agrees_with_loops():
    """Presence by sets, kernel by intersections, the solution of the weighted ridge equations by hand."""
    import numpy as np
    import pyarrow as pa

    from lectern.llm.wordarrays import buffers

    rng = random.Random(2)
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for letters in ("abcd ", "cdef ", "xyz ") for _ in range(12)] + ["", "é"]
    names = ["a"] * 12 + ["b"] * 12 + ["c"] * 14

    def marks(text):
        raw, out = bytes(x + 32 if 65 <= x <= 90 else x for x in text.encode()), set()
        for n in langid.LENGTHS:
            for i in range(len(raw) - n + 1):
                h = 0
                for x in raw[i : i + n]:
                    h = (h * 257 + x) % 2**32
                g = (h + n) * 2654435761 % 2**32
                g ^= g >> 15
                out.add(g * 2246822519 % 2**32 >> 20)
        return out

    sets = [marks(t) for t in texts]
    kernel = np.array([[len(s & t) / max(1, (len(s) * len(t)) ** 0.5) for t in sets] for s in sets])
    model = langid.train(list(zip(texts, names, strict=True)))
    values, vectors = np.linalg.eigh(kernel)  # every text is a landmark here
    keep = values > 1e-6 * values[-1]
    z = np.concatenate([kernel @ vectors[:, keep] / np.sqrt(values[keep]), np.ones((len(texts), 1))], axis=1)
    y = np.array([[float(n == m) for m in "abc"] for n in names])
    w = np.array([len(names) / 3 / names.count(n) for n in names])
    beta = np.linalg.solve(sum(w[i] * np.outer(z[i], z[i]) for i in range(len(z))) + langid.RIDGE * len(z) * np.eye(z.shape[1]), sum(w[i] * np.outer(z[i], y[i]) for i in range(len(z))))
    value = z @ beta
    best, score = langid.predict(model, *buffers(pa.array(texts)))
    assert best.tolist() == value.argmax(axis=1).tolist()
    assert np.allclose(score, np.clip(value.max(axis=1), 0, 1), atol=2e-3)
