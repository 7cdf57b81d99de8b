"""The pipeline's stages on small tables: what goes, what stays, and that the last stage packs the rest."""

from __future__ import annotations

import corpus_pipeline
import pytest

from lectern.llm import langid, toxicity
from lectern.llm.storage import stored
from lectern.session import table
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_jaccard_join import shingles


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    (_, language), (_, toxic), (_, near), (_, bench), (_, pack) = corpus_pipeline.STAGES
    kept = stored(language(spark, docs, sf_dir), "t")
    assert kept.columns == docs.columns
    assert kept.count() >= 0.99 * docs.count()
    calm = stored(toxic(spark, kept, sf_dir), "t")
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    clean = [d for d in rows(kept) if labels.get(d) == 0]
    assert sum(d in rows(calm) for d in clean) >= 0.95 * len(clean)
    single = stored(near(spark, calm, sf_dir), "t")
    expected = groups(list(rows(calm).items()))
    assert set(rows(single)) == {c for _, _, c in expected}
    fresh = stored(bench(spark, single, sf_dir), "t")
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert set(rows(fresh)) == {r[0] for r in leaks(list(rows(single).items()), items) if not r[5]}
    packed = pack(spark, fresh, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(rows(fresh))
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_repeated_rows_leave_one(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (3, None, None, None, None)], table(spark, sf_dir, "documents").schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")


def test_language_of_held_out_texts(spark, labelled, edge_docs):
    found = langid.identify(labelled[0]).withColumn("held", langid.held_out(langid.F.col("doc_id"))).filter("held").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.lang_score <= 1 for r in found)
    edge = {r.doc_id: r.lang_pred for r in langid.identify(edge_docs).collect()}
    assert all(edge[d] == "und" for d in (0, 1, 2, 3, 4, 16))
    assert {r.lang_pred for r in langid.identify(edge_docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_of_held_out_texts(spark, labelled, edge_docs):
    docs, labels = labelled
    scored = {r.doc_id: r for r in toxicity.score_documents(docs.withColumn("held", toxicity.held_out(docs["doc_id"])), labels).collect()}
    held = [(scored[r.doc_id].toxicity, r.toxic) for r in labels.collect() if scored[r.doc_id].held]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.85
    assert sum(b >= toxicity.CUT for b in bad) <= 0.1 * len(bad)
    assert toxicity.score_documents(edge_docs, labels).count() == edge_docs.count()
    nobody = toxicity.score_documents(edge_docs, labels.limit(0)).collect()
    assert {r.toxicity for r in nobody} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_near_copies_of_five_words_and_80_percent(spark, sf_dir):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:248])), (3, " ".join(f"x{i}" for i in range(300)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], table(spark, sf_dir, "documents").schema)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [1, 3]
    docs = table(spark, sf_dir, "documents")
    sets = [(r.doc_id, shingles(r.text, 5)) for r in docs.collect()]
    label = {d: d for d, _ in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and 100 * len(x & y) >= 80 * len(x | y):
                label[max(find(a), find(b))] = min(find(a), find(b))
    single = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d in label if find(d) == d)


def test_rows_of_one_id_with_different_texts_stay(spark, sf_dir):
    a, b, c = ("a b c d e f", "g h i j k l", "m n o p q r")
    rows = [(1, a), (1, b), (1, a), (2, b), (2, c), (3, a), (4, "s t u v w"), (5, None), (5, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], table(spark, sf_dir, "documents").schema)
    kept = [(r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(kept) == [(1, a), (1, b), (2, c), (4, "s t u v w"), (5, "")]
