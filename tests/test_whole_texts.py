"""Queries that keep tokens, grams and places within their text: against their SQL, with repeated ids and texts that are null."""

from __future__ import annotations

import re

import duckdb
import pytest

from lectern.functions import porter
from lectern.functions import words as W
from lectern.plans import all_oracles, all_queries

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
NAMES = ["A05_cluster_phrases", "A15_cluster_hits", "J17_collocation_pairs", "O07_top_phrases", "O05_top_collocations", "F30_scores_with_phrases", "L02_maximal_phrases", "W06_informative_sentences"]
#: Rows that repeat an id have ties that an ORDER BY leaves open; these have none.
REPEATED = ["L02_maximal_phrases"]


def shown(value):
    return f"{value:.8g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    rows = f"SELECT doc_id, text FROM (SELECT * FROM '{DOCUMENTS}' ORDER BY doc_id LIMIT 25)"
    odd = "SELECT * FROM (VALUES (900001, NULL), (900002, ''), (900003, 'don''t dont dont. Donts don''t dont! The the the')) t(doc_id, text)"
    duckdb.sql(f"COPY ({rows} UNION ALL {odd}) TO '{path}/documents.parquet'")
    again = path / "again"
    again.mkdir()
    duckdb.sql(f"COPY ({rows} UNION ALL {odd} UNION ALL SELECT doc_id - doc_id % 2, text FROM ({rows}) UNION ALL SELECT NULL, 'a b c d a b c d') TO '{again}/documents.parquet'")
    return path


def compare(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found, other = all_queries()[name](spark, str(folder)), con.sql(all_oracles()[name])
    columns = sorted(found.columns)
    assert columns == sorted(other.columns)
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    assert ours == sorted(tuple(shown(v) for v in r) for r in other.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    return found


@pytest.mark.parametrize("name", NAMES)
def test_only_texts_are_dealt(spark, name, folder):
    found = compare(spark, name, folder)
    keys = set(re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", found._jdf.queryExecution().executedPlan().toString()))
    named = {re.sub(r"#\d+L?", "", k) for k in keys}
    assert named <= {"doc_id", "doc_id, cluster"}  # clusters are of a text's top stems, and few


@pytest.mark.parametrize("name", REPEATED)
def test_repeated_ids(spark, name, folder):
    compare(spark, name, folder / "again")


def test_stems_in_python():
    words = sorted(set(re.findall("[a-z']+", " ".join(r[0].lower() for r in duckdb.sql(f"SELECT text FROM '{DOCUMENTS}'").fetchall()))))
    words += "aing eed agreed hopping sized sky rational caresses ties s ' '' o'ing adoption vietnamization roll probate".split()
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS lower", [words])
    for word, stem in con.sql(f"WITH {porter.stems_sql('words')} SELECT lower, stem FROM stems").fetchall():
        assert porter.stem(word) == stem, word
    assert W.TOKEN == "[A-Za-z']+"
