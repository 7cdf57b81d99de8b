"""Some queries against their DuckDB SQL on the smallest tables; all are compared at a larger scale elsewhere."""

from __future__ import annotations

import os

import duckdb
import pytest

from lectern.plans import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
NAMES = ["P02_front_matter", "F02_footnote_calls", "F04_clean", "P24_sanity_issues", "L01_verbatim_runs", "H02_cluster_review", "J04_drop_recurring_lines", "F09_sentences", "W01_rank_fraction_cutoff", "L02_maximal_phrases", "A19_term_dispersion", "J17_collocation_pairs", "A30_wilson_interval", "A36_homogeneity", "X01_incremental_log"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    return con


def shown(value):
    return f"{value:.8g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    found = all_queries()[name](spark, FOLDER)
    other = tables.sql(all_oracles()[name])
    assert sorted(found.columns) == sorted(other.columns)
    columns = sorted(found.columns)
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    theirs = sorted(tuple(shown(v) for v in r) for r in other.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert ours == theirs
