"""Edge cases that several operators share: very long texts, clashing names, rows without ids; and a toxicity model by loops."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import attribution, decontam, fingerprints, jaccard_join, langid, ngram_lm, packing, toxicity
from lectern.session import table
from tests.llm.test_tokens import ids_of

LONG = " ".join(f"word{i % 5000} and" for i in range(40_000))


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(1, LONG, "en"), (2, LONG + " end", "en"), (3, "a few words only", "en"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_very_long_texts(spark, long_docs):
    from lectern.llm.storage import stored

    items = spark.createDataFrame([(7, " ".join(LONG.split()[70_000:70_020]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.report(long_docs, items).collect()}
    assert found[1].n_words == 80_000 and found[1].n_hit == 20 * 8 and not found[3].contaminated
    groups = {r.doc_id: r.component_id for r in jaccard_join.linked_components(long_docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    n = len(ids_of(LONG))
    assert attribution.section_tokens(long_docs.filter("doc_id = 1")).first().n_tokens == n
    packed = packing.pack_documents(long_docs.filter("doc_id = 1")).collect()
    assert sum(r.length for r in packed) == n + 1 and max(r.length for r in packed) == 2048
    near = {r.doc_id: r.near_edited for r in fingerprints.edited_likeness(long_docs).collect()}
    assert near[1] > 0.8
    scored = {r.doc_id: r for r in ngram_lm.score_documents(stored(long_docs, "t"), langid.F.col("doc_id") != 2).collect()}
    assert scored[1].n_tokens == 80_001 and scored[2].n_known == 80_001
    assert {r.lang_pred for r in langid.identify(long_docs, langid.F.lit(True)).collect()} == {"en", "und"}


def test_clashing_names(spark, long_docs):
    docs = long_docs.selectExpr("doc_id", "text", "lang", "1 as lang_pred", "2 as lang_score", "3 as lang_letters", "4 as toxicity", "5 as toxic_in_language", "6 as n_words", "7 as key")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    found = langid.identify(docs).drop("lang_pred")
    assert "lang_letters" not in found.columns and dict(found.dtypes)["lang_score"] == "double"
    scored = toxicity.score_documents(docs, labels).select("doc_id", "toxicity", "toxic_in_language", "key").collect()
    assert len(scored) == 4 and all(0 <= r.toxicity <= 1 and r.key == 7 for r in scored)
    assert jaccard_join.linked_components(docs).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard_join.with_keys(docs.filter("doc_id = 3")).first().n_words == 6


def test_rows_without_ids(spark, sf_dir):
    a, b = "a b c d e f", "g h i j k l"
    rows = [(None, a), (None, a), (None, b), (1, b), (None, b + " m n o p q r s t u v w x y z"), (None, None), (2, "k l m")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], table(spark, sf_dir, "documents").schema)
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert kept == [(0, ""), (0, a), (0, b + " m n o p q r s t u v w x y z"), (1, b), (2, "k l m")]
    # Two different texts without ids that are linked: their texts are found by their keys.
    words = [f"w{i}" for i in range(200)]
    near = spark.createDataFrame([(None, " ".join(words), "en", "s", 0), (None, " ".join(words[:190]), "en", "s", 0)], docs.schema)
    assert corpus_pipeline.near_duplicates(spark, near, sf_dir).count() == 1


def test_empty_tables(spark, long_docs, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    assert corpus_pipeline.packed_sequences(spark, empty, sf_dir).count() == 0
    assert attribution.section_tokens(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity for r in toxicity.score_documents(long_docs, labels).collect()} == {0.0}


def test_a_score_of_the_cut_is_toxic(spark, sf_dir, monkeypatch):
    """With a model that gives every text 0.3 itself, the query predicts 1 and the pipeline's stage keeps nothing."""
    from lectern.llm import queries

    same = toxicity.Model(np.zeros((1, toxicity.SIZE)), [], np.zeros(0), np.zeros(0), 0.0, constant=toxicity.CUT)
    monkeypatch.setattr(toxicity, "train", lambda *_: (same, {}))
    assert {r.predicted for r in queries.op2_toxicity(spark, sf_dir).select("predicted").distinct().collect()} == {1}
    assert corpus_pipeline.toxic_documents(spark, table(spark, sf_dir, "documents"), sf_dir).count() == 0


def test_convolution_agrees_with_loops():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["good", "bad", "awful", "fine", "Day", "é"], rng.integers(0, 9))) for _ in range(40)]
    label = np.array([float("awful" in t) for t in texts])
    model, _ = toxicity.train(texts, label, np.ones(40), ["en"] * 40)
    ids, offsets = toxicity.buckets(pa.array(texts))
    found = toxicity.score(model, ids, offsets)
    for d in range(len(texts)):
        words = ids[offsets[d] : offsets[d + 1]]
        embedded = [sum(model.table[b].astype(float) for b in w) for w in words]
        hidden = []
        for f, width in zip(model.filters, toxicity.WIDTHS, strict=True):
            for j in range(toxicity.FILTERS):
                values = []
                for i in range(len(embedded)):
                    v = float(model.bias[len(hidden)])
                    for k in range(width):
                        if i + k < len(embedded):
                            v += float(embedded[i + k] @ f[k, :, j])
                    values.append(v)
                hidden.append(max([0.0, *values]))
        logit = sum(h * float(o) for h, o in zip(hidden, model.out, strict=True)) + model.out_bias
        a, b = model.scale
        assert found[d] == pytest.approx(1 / (1 + np.exp(-(a * logit + b))), abs=1e-4)


def test_held_out_rows_follow_the_checksum(spark):
    rows = spark.createDataFrame([(i,) for i in range(-5, 200)], "doc_id long")
    found = rows.select("doc_id", toxicity.held_out(rows.doc_id).alias("t"), langid.held_out(rows.doc_id).alias("l"), ngram_lm.held_out(rows.doc_id).alias("m")).collect()
    for r in found:
        c = zlib.crc32(str(r.doc_id).encode())
        assert (r.t, r.l, r.m) == (c % 4 == 2, c % 3 == 1, c % 5 == 1)
