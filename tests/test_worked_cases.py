"""Operators against results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import audit, cleaning, reviews, sequences


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", expression.alias("out")).orderBy("i")
    return [r.out for r in rows.collect()]


def test_footnote_calls(spark):
    cases = {"knowledge1 is": "knowledge is", "topic.2 Next": "topic. Next", "network10": "network", "in 1999": "in 1999", "a123": "a123", "x1y2": "xy2", "2.1 Title": "2.1 Title", "end)’3 so": "end)’ so", "a1 b2 c3": "a b c"}
    assert values(spark, cases, cleaning.drop_footnote_calls(F.col("text"))) == list(cases.values())


def test_markdown(spark):
    cases = {
        "```python\nx = 1\n```\nafter": "x = 1\nafter\n",
        "snake_case_name stays, _this_ does not": "snake_case_name stays, this does not\n",
        "# Title\n\n> quoted\n\n- item\n1. first\n": "Title\n\nquoted\n\nitem\nfirst\n",
        "![alt](u.png \"t\") [text](http://x) [two][ref]\n[ref]: http://y": "alt text two\n",
        "***a*** **b** __c__ ~~d~~ `e`": "a b c d e\n",
        "| h | k |\n|---|:--:|\n| 1 | 2 |": "h   k \n\n 1   2\n",
        "one\n\n\n\n---\n\ntwo <b>three</b>": "one\n\ntwo three\n",
    }
    assert values(spark, cases, cleaning.markdown_to_prose(F.col("text"))) == list(cases.values())


def test_front_matter_and_notes(spark):
    text = "Minds (2024)\nReceived: May. Accepted: June\nName\nx@y.org\nOf the Université\n3.1. Introduction to it\nAbstract ideas\nBody\n FOOTNOTES \nlast"
    rows = W.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    kept = [r.line for r in cleaning.drop_end_sections(cleaning.drop_front_matter(rows)).orderBy("line_no").collect()]
    assert kept == ["Name", "3.1. Introduction to it", "Abstract ideas", "Body"]
    hits = [(r.line_no, r.tag) for r in cleaning.front_matter_hits(rows).orderBy("line_no").collect()]
    assert hits == [(0, "journal_masthead"), (1, "article_history"), (3, "email"), (4, "affiliation"), (6, "abstract_heading")]
    rows = W.lines(spark.createDataFrame([(1, "Works cited\nintroduction\nCopyright 2024")], "doc_id long, text string"))
    assert cleaning.drop_end_sections(cleaning.drop_front_matter(rows)).count() == 3


def test_glued_words(spark):
    docs = spark.createDataFrame([(1, "Domainindependent tests_domainindependent and independent domains"), (2, "short"), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame([(w,) for w in ("domain", "independent", "domains", "and")], "word string")
    found = sorted(r.text or "" for r in cleaning.rewrite_glued_words(docs, known).collect())
    assert found == ["", "Domain independent tests_domainindependent and independent domains", "short"]


def test_similarity(spark):
    rows = spark.createDataFrame([(0, "a b c d", "d c b a"), (1, "", ""), (2, "a b c d e f", "b c d"), (3, "a", ""), (4, None, "x")], "i long, a string, b string")
    found = [(r.s.ratio, r.s.containment) for r in rows.select("i", sequences.word_similarity("a", "b").alias("s")).orderBy("i").collect()]
    assert found == [(0.25, 0.25), (1.0, 1.0), (pytest.approx(2 / 3), 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_provenance(spark):
    whole = "The model learns rules. Rules help people think clearly about the world."
    one, two = "The model learns rules.", "Rules help people think clearly about the world."
    cases = [
        ("The model learns rules", one, 1.0, 0.3, None, None),
        ("However, the model learns rules.", one, 0.8, 0.1, "F", "diff_connective"),
        ("Furthermore, then", None, None, None, "F", "pure_connective_no_match"),
        ("In what follows we look at rules.", one, 0.2, 0.1, "T", "phrase_match"),
        ("The model learns strange rules.", one, 0.9, 0.1, "T", "diff_lexical"),
        ("Strange models of many other kinds never really learn any rules whatsoever", one, 0.6, 0.1, "R", "dominant_source"),
        ("Strange models of many other kinds never really learn any rules whatsoever", two, 0.3, 0.25, "C", "several_sources"),
    ]
    rows = spark.createDataFrame([(i, t, whole, s, b, c) for i, (t, s, b, c, _, _) in enumerate(cases)], "span_id long, text string, whole string, source string, best double, second double")
    spans = sequences.classify_spans(rows)
    assert {r.span_id: (r.kind, r.basis) for r in spans.collect()} == {i: (k, b) for i, (*_, k, b) in enumerate(cases) if k}
    assert {r.span_id for r in sequences.borderline_flags(spans).collect()} == set()
    many = spark.createDataFrame([(9, "This paper shows large gains for small language models everywhere", whole, None, None, None)], rows.schema)
    assert [r.against for r in sequences.borderline_flags(sequences.classify_spans(many)).collect()] == [4]


def test_sanity(spark):
    known = "the model learns many rules and people use them".split()
    cases = {
        "The model learns rules. People use them.": [],
        "Zorp blick fnord quux zib. The model learns.": ["invented_run"],
        "the model " + "x" * 31 + " learns many rules": ["long_word"],
        "the model learns many rules and the model learns many rules and": ["repeated_phrase"],
        "": [],
    }
    rows = spark.createDataFrame([(i, t, known) for i, t in enumerate(cases)], "i long, text string, vocabulary array<string>")
    assert [r.issues for r in audit.sanity_issues(rows).orderBy("i").collect()] == list(cases.values())


def test_chunks(spark):
    text = " ".join(map(str, range(250))) + "\n \nlast one\n\n\n"
    (chunks,) = values(spark, [text], W.paragraph_chunks(F.col("text"), 120))
    assert [len(c.split()) for c in chunks] == [120, 120, 10, 2] and chunks[-1] == "last one"


def test_windows_and_budgets(spark):
    texts = ['one "two" three AI four', "no such word", "main again AI, then", "AI"]
    found = values(spark, texts, reviews.marked_word(F.col("text"), F.lit("ai"), 2))
    assert found == ['... two three "AI" four', "no such word", 'main again "AI" , then', '"AI"']
    (given,) = values(spark, ["x"], reviews.fitted_contexts(F.array(*(F.lit(n) for n in (2, 30, 30, 4))), 40))
    assert given == [2, 12, 13, 4]
    assert values(spark, ["2, 4", " ALL", "", "two", "3"], reviews.picked_places(F.col("text"))) == [[2, 4], [-1], [], None, [3]]


def test_files(spark, tmp_path):
    from lectern.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "minds-condensed-25pct.txt").write_text("one\ntwo\n")
    (tmp_path / "a" / "minds-condensed-5pct.txt").write_text("three")
    (tmp_path / "a" / "other.txt").write_text("four")
    found = {(r.corpus, r.rate, r.text) for r in files.read_condensed(spark, str(tmp_path)).collect()}
    assert found == {("minds", 25, "one\ntwo\n"), ("minds", 5, "three")}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.PDF").write_bytes(b" page one \f\f page two")
    pages = lambda content: F.split(F.decode(content, "UTF-8"), "\f")
    assert files.read_texts(spark, str(tmp_path / "b"), pages).first().text == "page one\n\npage two"
    with pytest.raises(Exception, match="no reader of PDF"):
        files.read_texts(spark, str(tmp_path / "b")).collect()
    with pytest.raises(Exception, match="no text in"):
        files.read_texts(spark, str(tmp_path / "b"), lambda c: F.array(F.lit(" "))).collect()
    assert files.environment(spark).first().master.startswith("local")


def test_recovered_noise(spark):
    from lectern.operators.clustering import recovered_noise

    points = [(1, "ab"[i % 2], i, [1.0, 0.01 * i]) for i in range(8)] + [(1, "bc"[i % 2], 100 + i, [0.01 * i, 1.0]) for i in range(8)] + [(1, "d", 500, [-1.0, -1.0])]
    found = recovered_noise(spark.createDataFrame(points, "doc_id long, term string, item long, vector array<double>")).collect()
    assert sorted(r.stems for r in found) == [["a", "b"], ["b", "c"]]
