from __future__ import annotations

import pytest

EDGE_TEXTS = [
    None, "", " ", "\n", "\n\n\n", "one", "Two  words", "tabs\tand\r\nreturns  \n x", "ünï çødé — 漢字 かな　x", "a" * 5000,
    "the cat sat on the mat. " * 400, "x y z   q", "\x1c\x85 odd", "don't we'll  I'd", "<|endoftext|> tail", "emoji 😀 👨‍👩‍👧 done", "0 1 22 333", "zero\0byte",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(5, "one", "en", "s", 3), (5, "one", "en", "s", 3), (40, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory):
    """The smallest tables, where the driver put them."""
    return "/root/testdata/sf0.001"
