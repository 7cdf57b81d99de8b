"""Operators on small inputs, against values derived by hand or by the standard library."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectern.functions import porter
from lectern.functions import words as W
from lectern.operators import audit, cleaning, clustering, phrases, reading, verification, vocabulary
from lectern.sources import files


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_cleaning(spark):
    assert one(spark, cleaning.join_hyphenated, "epi-\nstemic") == "epistemic"
    assert [one(spark, cleaning.drop_footnote_calls, t) for t in ("topic.2", "1999", "H2")] == ["topic.", "1999", "H"]
    assert one(spark, cleaning.squeeze, "  a \t b\n\n\n\nc ") == "a b\n\nc\n"
    rows = W.lines(docs(spark, "Page 1\nPage 2\nPage 3\nPage 4\nbody"))
    assert [r.line for r in cleaning.drop_recurring_lines(rows).collect()] == ["body"]
    rows = W.lines(docs(spark, "https://doi.org/10.1234/x\nIntroduction\nsee doi here\n12\nReferences\nx"))
    kept = cleaning.drop_page_numbers(cleaning.drop_end_sections(cleaning.drop_front_matter(rows)))
    assert [r.line for r in kept.orderBy("line_no").collect()] == ["Introduction", "see doi here"]
    assert cleaning.clean(docs(spark, "a-\nb  c\n\n\n\nd", None, "")).filter("doc_id = 0").first().text == "ab c\n\nd\n"
    assert one(spark, cleaning.markdown_to_prose, "# T\n\n**b** [l](u) `c`\n- x") == "T\n\nb l c\nx\n"


def test_porter(spark):
    # Pairs from the published algorithm's own examples.
    pairs = dict(caresses="caress", ponies="poni", agreed="agre", motoring="motor", hopping="hop", filing="file", happy="happi", relational="relat", formalize="formal", goodness="good", adoption="adopt", probate="probat", controll="control")
    rows = spark.createDataFrame([(w,) for w in pairs], "lower string")
    assert {r.lower: r.stem for r in porter.stems(rows).collect()} == pairs


def test_rank_cut(spark):
    rows = spark.createDataFrame([(1, f"s{i}", 10 - i, i) for i in range(10)], "doc_id long, stem string, cnt long, first_pos int")
    assert vocabulary.rank_cut(rows, 0.75, 150).count() == 3
    assert vocabulary.rank_cut(rows, 0.7, 150).count() == 4  # 10 x (1 - 0.7) is a little over 3 in binary
    assert vocabulary.rank_cut(rows, 0.0, 5).count() == 5


def test_phrases(spark):
    counts = spark.createDataFrame([(1, 2, "a b", 5, 0), (1, 3, "a b c", 2, 0), (1, 2, "x a", 2, 3)], "doc_id long, n int, gram string, cnt long, first_pos int")
    assert {r.gram for r in phrases.maximal(counts).collect()} == {"a b c", "x a"}


def test_bands_and_bins(spark):
    a = spark.createDataFrame([(1, 10), (1, 20)], "doc_id long, pos int")
    b = spark.createDataFrame([(1, 10), (1, 14), (1, 26)], "doc_id long, pos int")
    assert [r.pos for r in reading.band_pairs(a, b, 5).collect()] == [10]
    rows = spark.createDataFrame([(1, "t", p, 11) for p in range(11)], "doc_id long, term string, pos int, n_tokens int")
    hits = reading.binned_counts(reading.with_bins(rows, 5), "term", 5).orderBy("bin").collect()
    assert [r.hits for r in hits] == [3, 3, 3, 2, 0]


def test_wilson(spark):
    # Published pairs.
    for k, n, low, high in ((296, 385, 0.7241885461394967, 0.8081620952447947), (0, 385, 0.0, 0.009879241869796428), (2, 2, 0.34238022750665303, 1.0)):
        got = spark.range(1).select(*audit.wilson(F.lit(k), F.lit(n))).first()
        assert tuple(got) == pytest.approx((low, high))


CASES = [
    (True, "", "call_failed"), (False, "  ", "empty_response"), (False, "hm", "unparseable"), (False, "VERDICT: ok", "ok"), (False, "VERDICT: FIXED", "fixed_no_text"), (False, "VERDICT: FIXED\nTEXT:  ", "fixed_no_text"),
    (False, "VERDICT: FIXED\nTEXT: " + "w " * 30, "fixed_rejected_short"), (False, "VERDICT: FIXED\nTEXT: " + "o " * 120, "fixed_identical"), (False, "VERDICT: FIXED\nTEXT: " + "o\n" * 120, "fixed_identical"),
    (False, "VERDICT: FIXED\nTEXT: " + "o " * 119 + "x", "fixed_changed"), (False, "VERDICT: FIXED\nTEXT: " + "o " * 160, "fixed_expanded"),
]


def test_outcomes(spark):
    rows = spark.createDataFrame([(i, failed, answer, "o " * 120, 100, 120) for i, (failed, answer, _) in enumerate(CASES)], "i int, failed boolean, response string, original string, target int, n_original int")
    got = audit.parsed(F.col("response"))
    rows = rows.withColumns({"verdict": got["verdict"], "fixed": got["text"]}).withColumn("n_fixed", W.word_count(F.col("fixed")))
    assert [r.category for r in audit.outcome(rows).orderBy("i").collect()] == [c for _, _, c in CASES]


def test_coverage_dark_before_tolerance(spark):
    source = spark.createDataFrame([(1, "a", 3), (1, "b", 97)], "doc_id long, cluster string, hits long")
    summary = spark.createDataFrame([(1, "b", 50)], "doc_id long, cluster string, hits long")
    assert {r.cluster: r.status for r in verification.coverage(source, summary).collect()} == {"a": "DARK", "b": "OK"}


def test_density_clusters(spark):
    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    labels = clustering.hdbscan(blobs, 5)
    assert {frozenset(np.flatnonzero(labels == k) // 30) for k in range(labels.max() + 1)} == {frozenset({0}), frozenset({1}), frozenset({2})}
    assert (clustering.hdbscan(blobs[:4], 5) == -1).all()
    assert len(clustering.hdbscan(np.zeros((10, 2)), 3)) == 10
    rows = spark.createDataFrame([(1, i, b.tolist()) for i, b in enumerate(blobs + 1)], "doc_id long, item long, vector array<double>")
    assert clustering.cluster_vectors(rows, "doc_id", largest=25).count() == 90
    words = spark.createDataFrame([(1, c, "x", 2) for c in "abc"], "doc_id long, cluster string, word string, cnt long")
    assert sorted(r.name for r in clustering.cluster_names(words).collect()) == ["x", "x (2)", "x (3)"]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é\r\nx\ry".encode())
    assert [(r.kind, r.text) for r in files.read_texts(spark, str(tmp_path / "*.TXT")).collect()] == [("txt", "é\nx\ny")]
    (tmp_path / "b.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unknown kind"):
        files.read_texts(spark, str(tmp_path / "*.exe")).collect()
    (tmp_path / "state.json").write_text('{"excludedNgrams": ["a b"],\n "clusterDefs": [{"name": "x", "stems": ["s"]}]}')
    state = files.read_state(spark, str(tmp_path / "state.json")).first()
    assert state.clusterDefs[0].stems == ["s"] and state.clusterDefs[0].reembedded_stems is None
    log = spark.sql("select timestamp'2020-01-01' as timestamp, 'c' as corpus, 'p' as phase, 's' as step, 'd' as decision_type, '' as prompt, '[]' as options, 'one' as choice, '{}' as extra")
    for choice, day in (("one", "2020-01-01"), ("two", "2020-01-02")):
        files.append_decisions(log.withColumn("choice", F.lit(choice)).withColumn("timestamp", F.to_timestamp(F.lit(day))), str(tmp_path / "log"))
    assert files.latest(files.read_decisions(spark, str(tmp_path / "log"))).first().choice == "two"


def test_entry_and_registry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
