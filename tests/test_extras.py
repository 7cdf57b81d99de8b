"""Queries of smaller operators against brute force."""

from __future__ import annotations

import re

import duckdb
import numpy as np

from lectern.operators import sequences, verification
from lectern.plans import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[A-Za-z']+", (text or "").lower())


def runs(items, sources):
    known = {k: {tuple(w[i : i + k]) for w in map(words, sources) for i in range(len(w) - k + 1)} for k in range(4, 41)}
    out = []
    for d, text in items:
        w, i = words(text), 0
        while i < len(w):
            k = next((k for k in range(min(40, len(w) - i), 3, -1) if tuple(w[i : i + k]) in known[k]), 0)
            out += [(d, i, k)] * (k > 0)
            i += k or 1
    return sorted(out)


def test_permutation_p_takes_ten_thousand_shuffles(spark):
    p = all_queries()["A37_permutation_p"](spark, FOLDER).first().p
    assert abs(p * 10_001 - round(p * 10_001)) < 1e-6


def test_permutation_p_agrees_with_shuffled_labels(spark):
    pairs = [("a", "x")] * 12 + [("a", "y")] * 8 + [("b", "x")] * 7 + [("b", "y")] * 13
    found = sequences.permutation_p(spark.createDataFrame(pairs, "r string, c string"), "r", "c", 4000).first()
    rng, r, c = np.random.default_rng(1), np.array([x == "a" for x, _ in pairs]), np.array([y == "x" for _, y in pairs])
    seen = abs((r & c).sum() - r.sum() * c.sum() / len(r))
    above = [abs((r & m).sum() - r.sum() * m.sum() / len(r)) >= seen - 1e-9 for m in (rng.permutation(c) for _ in range(4000))]
    assert abs(found.p - np.mean(above)) < 0.03
    apart = [("a", "x")] * 40 + [("b", "y")] * 40
    assert sequences.permutation_p(spark.createDataFrame(apart, "r string, c string"), "r", "c", 10_000).first().p == 1 / 10_001


def test_verbatim_runs(spark):
    w = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnopqr"]
    sources = [" ".join(w[:7]), " ".join(w[5:16]), " ".join(w[20:75]), " ".join(["z y z y z y"]), None]
    items = [(1, " ".join(w)), (2, " ".join(["q", *w[:7], "q", *w[6:11], "q", *w[10:13]])), (3, "z y z y z y z y"), (4, None), (5, " ".join(w[5:16]))]
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(sources)], "doc_id long, text string")
    found = verification.verbatim_runs(spark.createDataFrame(items, "doc_id long, text string"), rows)
    expected = runs(items, sources)
    assert {k for _, _, k in expected} >= {5, 7, 11, 40}
    assert sorted(map(tuple, found.collect())) == expected


def test_verbatim_runs_of_whole_tables(spark):
    both = [spark.read.parquet(f"{FOLDER}/{t}.parquet").select(i, "text").collect() for t, i in (("benchmark", "item_id"), ("documents", "doc_id"))]
    expected = runs([tuple(r) for r in both[0]], [r.text for r in both[1]])
    assert sorted((r.item_id, r.pos, r.length) for r in all_queries()["L01_verbatim_runs"](spark, FOLDER).collect()) == expected


def test_aligned_hits_are_of_all_documents(spark):
    from tests.test_queries import shown

    name, con = "J28_aligned_cluster_hits", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    other = con.sql(all_oracles()[name])
    found = all_queries()[name](spark, FOLDER).select(*other.columns).collect()
    assert any(r.doc_id % 2 for r in found)
    assert sorted(tuple(map(shown, r)) for r in found) == sorted(tuple(map(shown, r)) for r in other.fetchall())
