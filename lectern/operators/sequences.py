"""Comparisons of word sequences, which are inherently sequential within a pair of texts: Arrow batches of pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.words import is_function_word, word_array

#: A type, not a string of one, as strings are parsed by a session and modules are imported without.
SIMILARITY = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("containment", T.DoubleType())])


@F.pandas_udf(SIMILARITY)
def word_similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Ratcliff-Obershelp ratio of two texts' words, and the share of the second's words that lie in blocks which both
    share in order. Two texts without words are the same: 1 and 1."""
    ratio, inside = [], []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        x, y = x.split(), y.split()
        pair = difflib.SequenceMatcher(None, x, y, autojunk=False)
        shared = sum(block.size for block in pair.get_matching_blocks())
        ratio.append(pair.ratio())
        inside.append(shared / len(y) if y else float(not x))
    return pd.DataFrame({"ratio": ratio, "containment": inside})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def inserted_places(source: pd.Series, words: pd.Series) -> pd.Series:
    """Places of a text's words, an array, that it inserts or replaces in the words of its source, another array."""
    out = []
    for x, y in zip(source, words, strict=True):
        x, y = list(x if x is not None else ()), list(y if y is not None else ())
        blocks = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        out.append([k for kind, _, _, i, j in blocks if kind in ("insert", "replace") for k in range(i, j)])
    return pd.Series(out)


# Phrases that mark talk about the text itself, and parts of speech of connectives and of lexical words.
TALK = (
    "this paper", "this section", "this study", "this article", "this chapter", "the paper", "the article", "the following section",
    "the following sections", "these considerations", "this argument", "the argument", "as we have seen", "in what follows", "we now turn",
    "we conclude", "to summarize", "in sum", "this discussion", "the discussion above", "the preceding", "the remainder of",
)
CONNECTIVE_POS = ("CCONJ", "SCONJ")
LEXICAL_POS = ("NOUN", "PROPN", "VERB", "ADJ", "PRON", "ADV", "NUM")


def is_talk(text: Column) -> Column:
    """Whether a sentence holds any phrase of talk about the text."""
    return F.exists(F.array(*(F.lit(m) for m in TALK)), lambda m: F.contains(F.lower(text), m))


def is_connective(token: Column) -> Column:
    return token["pos"].isin(*CONNECTIVE_POS) | (token["dep"] == "advmod") | ((token["pos"] == "ADV") & (token["dep"] == "ROOT"))


def is_lexical(token: Column) -> Column:
    return ~is_connective(token) & (token["pos"].isin(*LEXICAL_POS) | token["tag"].startswith("W"))


#: Words that the tagger below takes for connectives; a list of this library's own.
CONJUNCTIONS = ("and", "but", "or", "nor", "yet", "because", "although", "though", "since", "while", "whereas", "if", "that", "unless", "until")
SENTENCE_ADVERBS = ("however", "furthermore", "therefore", "thus", "moreover", "hence", "nevertheless", "consequently", "indeed", "then", "also")


def tagged_by_lists(text: Column) -> Column:
    """Tokens (text, pos, dep, tag) of a sentence without a language model: conjunctions and sentence adverbs by lists,
    function words as ADP, all others as NOUN. A tagger of another kind gives an array of the same fields."""

    def token(w: Column) -> Column:
        low = F.lower(w)
        pos = F.when(low.isin(*CONJUNCTIONS), "SCONJ").when(low.isin(*SENTENCE_ADVERBS), "ADV").when(is_function_word(low), "ADP").otherwise("NOUN")
        return F.struct(w.alias("text"), pos.alias("pos"), F.when(low.isin(*SENTENCE_ADVERBS), "advmod").otherwise("dep").alias("dep"), F.lit("").alias("tag"))

    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}']+)"), F.lit(1)), token)


def stripped_of_marks(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")


def classify_spans(spans: DataFrame, tagger=tagged_by_lists) -> DataFrame:
    """Provenance of a sentence, from its best source sentence: F, differs by up to four connectives, or is nothing but
    such; T, talk about the text, or differs by up to six words, a lexical one among them; R, the paraphrase of one
    sentence; C, drawn from several. Sentences that the whole source holds literally are not classified.

    spans: span_id, text, whole (the source's text), source (its best sentence, null if none shares a word), best and second
    (shares of content words). Adds kind, basis and added, the words that differ."""
    words = F.transform("tokens", lambda t: F.lower(t["text"]))
    source = F.regexp_extract_all(F.lower(F.coalesce("source", F.lit(""))), F.lit("([a-z']+)"), F.lit(1))
    squeezed = F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    rows = spans.filter(~F.contains(stripped_of_marks(F.col("whole")), stripped_of_marks(squeezed))).withColumn("tokens", tagger(F.col("text")))
    rows = rows.withColumn("places", F.when(F.col("source").isNull(), F.array().cast("array<int>")).otherwise(inserted_places(source, words)))
    rows = rows.withColumn("diff", F.transform("places", lambda k: F.get("tokens", k)))
    n, none = F.size("diff"), F.col("source").isNull()
    basis = (
        F.when((n > 0) & (n <= 4) & F.forall("diff", is_connective), "diff_connective")
        .when(none & F.size("tokens").between(1, 4) & F.forall("tokens", is_connective), "pure_connective_no_match")
        .when(is_talk(F.col("text")), "phrase_match")
        .when((n > 0) & (n <= 6) & F.exists("diff", is_lexical), "diff_lexical")
        .when(~none & (F.col("best") >= 0.5) & (F.col("best") - F.col("second") >= 0.15), "dominant_source")
        .otherwise("several_sources")
    )
    rows = rows.withColumn("basis", basis)
    kind = F.when(F.col("basis").isin("diff_connective", "pure_connective_no_match"), "F").when(F.col("basis").isin("phrase_match", "diff_lexical"), "T").when(F.col("basis") == "dominant_source", "R").otherwise("C")
    return rows.withColumn("kind", kind).withColumn("added", F.col("diff.text")).drop("tokens", "places", "diff")


# Nouns that make connectives of phrases.
DISCOURSE_NOUNS = ("contrast", "sum", "short", "turn", "addition", "regard", "view")


def _content_bearing(words: Column, more: tuple[str, ...]) -> Column:
    letters = lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]", ""))
    return F.filter(words, lambda w: (letters(w) != "") & ~is_function_word(letters(w)) & ~letters(w).isin(*more))


def borderline_flags(spans: DataFrame) -> DataFrame:
    """Spans of F or T whose class a word list does not bear out, and how many words speak against it.

    spans: what ``classify_spans`` gives."""
    whole, added = word_array(F.col("text")), F.col("added")
    adverbs = DISCOURSE_NOUNS + SENTENCE_ADVERBS
    n = (
        F.when(F.col("basis") == "pure_connective_no_match", F.greatest(F.size(_content_bearing(whole, adverbs)), F.when(F.size(whole) > 4, 1).otherwise(0)))
        .when(F.col("basis") == "diff_connective", F.size(_content_bearing(added, adverbs)))
        .when((F.col("basis") == "phrase_match") & F.col("source").isNotNull() & (F.col("best") >= 0.7), F.size(_content_bearing(added, DISCOURSE_NOUNS)))
        .when(F.col("basis") == "phrase_match", F.greatest(F.size(_content_bearing(whole, DISCOURSE_NOUNS)) - 4, F.lit(0)))
        .otherwise(0)
    )
    return spans.withColumn("against", n).filter("against > 0")


def permutation_p(rows: DataFrame, row: str, column: str, n: int = 1000, seed: int = 7) -> DataFrame:
    """Share of shuffles of a contingency table's labels with a statistic at least as large. The table of counts is
    small; shuffles are dealt over tasks by number."""
    import numpy as np

    counts = rows.groupBy(row, column).agg(F.count("*").alias("o")).toPandas()  # classes by classes
    table = counts.pivot(index=row, columns=column, values="o").fillna(0).to_numpy(dtype=float)

    def statistic(t: np.ndarray) -> float:
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
        return float(((t - e) ** 2 / e).sum())

    sizes, margin = table.sum(1).astype(int), table.sum(0).astype(int)
    seen = statistic(table)

    def shuffle(batches):
        for part in batches:
            out = []
            for i in part["id"]:
                rng, left, t = np.random.default_rng([seed, i]), margin.copy(), np.zeros(table.shape)
                for k, size in enumerate(sizes):  # a shuffle of labels: each group draws from what others left
                    drawn = rng.multivariate_hypergeometric(left, size, method="marginals")
                    t[k] = drawn
                    left -= drawn
                out.append(statistic(t) >= seen - 1e-9)
            yield pd.DataFrame({"above": out})

    done = rows.sparkSession.range(n).mapInPandas(shuffle, "above boolean")
    return done.agg(((F.count_if("above") + 1) / (F.count("*") + 1)).alias("p")).withColumn("chi2", F.lit(seen))
