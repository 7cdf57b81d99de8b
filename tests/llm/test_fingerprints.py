"""Operator 1 against sets of shingles and the edit as plain Python."""

from __future__ import annotations

import hashlib

from lectern.llm import fingerprints
from lectern.session import table


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(docs):
    docs = sorted(docs, key=lambda r: -r[0])
    out = {}
    for k, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(text) // 3
        out[doc] = (text, text[: len(text) - n] + after[:n], after)
    return out


def check(docs):
    expected = edits([(r.doc_id, r.text) for r in docs.collect()])
    rows = fingerprints.edited_likeness(docs).collect()
    assert len(rows) == len(expected)
    errors = []
    for r in rows:
        text, edited, after = expected[r.doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(r.near_edited - jaccard(text, edited))
        errors.append(r.near_next - jaccard(text, after))
    return rows, errors


def test_whole_table(spark, sf_dir):
    rows, errors = check(table(spark, sf_dir, "documents"))
    assert sum(map(abs, errors)) / len(errors) < 0.02
    assert max(map(abs, errors)) < 0.2
    by_text = {}
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_many_buckets_and_gaps(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    docs = table(spark, sf_dir, "documents").selectExpr("case when doc_id < 50 then doc_id else doc_id * 97 end as doc_id", "text")
    check(docs)


def test_far_ids_do_not_fill_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 20)
    ids = [*range(400), 10**12, -(2**62), 2**62]
    docs = spark.createDataFrame([(i, f"text of the number {i % 7} here and there") for i in ids], "doc_id long, text string")
    check(docs)
    cuts = list(range(0, 400, 20))
    found = docs.select("doc_id", fingerprints._number_below(docs["doc_id"], cuts).alias("n")).collect()
    assert all(r.n == sum(c <= r.doc_id for c in cuts) for r in found)


def test_edges(spark, edge_docs, empty_docs):
    docs = edge_docs.dropDuplicates(["doc_id"])
    rows, _ = check(docs)
    blank = [r for r in rows if r.doc_id in (0, 1, 3)]
    assert {r.fingerprint for r in blank} == {""}
    assert fingerprints.edited_likeness(empty_docs).count() == 0
    assert fingerprints.edited_likeness(docs.filter("doc_id = 6")).count() == 1
    assert fingerprints.edited_likeness(edge_docs).count() == edge_docs.count()


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = fingerprints.edited_likeness(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
