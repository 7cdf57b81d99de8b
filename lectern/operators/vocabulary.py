"""Ranked vocabularies: stems and words by frequency, cuts by rank, and where stems occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.porter import stems
from lectern.functions.words import FUNCTION_WORDS, is_function_word, tokens


#: Parts that each function word is dealt to when tokens meet stems.
SALT = 64


def with_stems(rows: DataFrame) -> DataFrame:
    """Rows with a column ``lower`` and the stem of each. Only distinct words are stemmed.

    Words are frequent in very unlike measure, and the most frequent ones are function words, so those are dealt to many
    parts; no word then is a large share of what one task joins, even where the table of stems is too large to broadcast."""
    salt = lambda w: F.when(is_function_word(w), F.lit(SALT)).otherwise(F.lit(1))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salt(F.col("lower"))).cast("int"))
    right = stems(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), salt(F.col("lower")) - 1)))
    return left.join(right, ["lower", "salt"]).drop("salt")


def stemmed_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token, lower, stem."""
    return with_stems(tokens(docs))


def is_content(lower=None):
    lower = F.col("lower") if lower is None else lower
    return lower.rlike("^[a-z]+$") & ~is_function_word(lower)


def stem_counts(rows: DataFrame) -> DataFrame:
    """Content stems of each text with counts and first places."""
    return rows.filter(is_content()).groupBy("doc_id", "stem").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


def rank_cut(counts: DataFrame, share: float, most: int, by=("doc_id",)) -> DataFrame:
    """The first ceil(n (1 - share)), ``most`` at most, by count and then first place; rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("cnt"), "first_pos")
    n = F.count("*").over(Window.partitionBy(*by))
    limit = F.least(F.ceil(n * (F.lit(1.0) - F.lit(float(share)))), F.lit(most))
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("keep", limit).filter("rank <= keep").drop("keep")


def corpus_stems(rows: DataFrame, share: float, most: int) -> DataFrame:
    """The same cut over all texts together: a global top-k, so no window over the whole vocabulary in one task."""
    counts = rows.filter(is_content()).groupBy("stem").agg(F.count("*").alias("cnt"))
    n = counts.count()
    import math

    return counts.orderBy(F.desc("cnt"), "stem").limit(min(most, math.ceil(n * (1 - share))))


def occurrences(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Tokens whose stem is among a text's top stems; function words stay if their stem does."""
    return rows.filter(F.col("lower").rlike("^[a-z]+$")).join(top.select("doc_id", "stem"), ["doc_id", "stem"])


def words_of_stems(rows: DataFrame, share: float, least: int) -> DataFrame:
    """Words of each stem by frequency: the first ceil(n (1 - share)), but ``least`` at least."""
    counts = rows.groupBy("doc_id", "stem", F.col("lower").alias("word")).agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("doc_id", "stem").orderBy(F.desc("cnt"), "first_pos")
    n = F.count("*").over(Window.partitionBy("doc_id", "stem"))
    keep = F.greatest(F.ceil(n * (F.lit(1.0) - F.lit(float(share)))), F.lit(least))
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("keep", keep).filter("rank <= keep").drop("keep", "first_pos")


def first_occurrences(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("doc_id", "stem").orderBy("pos")
    return rows.withColumn("n", F.row_number().over(order).cast("long")).filter(F.col("n") <= k)


def pseudo_clusters(top: DataFrame, k: int = 3) -> DataFrame:
    """Deterministic clusters of the top stems, by rank."""
    return top.select("doc_id", "stem", "rank", F.concat(F.lit("cluster_"), (F.col("rank") % k).cast("string")).alias("cluster"))


def sweep(rows: DataFrame, shares: list[float]) -> DataFrame:
    """For each candidate share: stems kept, distinct words, tokens hit. The cap on stems is ignored here on purpose."""
    counts = stem_counts(rows)
    order = Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "first_pos")
    ranked = counts.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    tried = ranked.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).filter(F.col("rank") <= F.ceil(F.col("n") * (F.lit(1.0) - F.col("share"))))
    hit = rows.filter(F.col("lower").rlike("^[a-z]+$")).join(tried.select("doc_id", "stem", "share"), ["doc_id", "stem"])
    return hit.groupBy("doc_id", "share").agg(F.count_distinct("stem").alias("n_stems"), F.count_distinct("lower").alias("n_words"), F.count("*").alias("n_hits"))


# Abbreviations of citations, and what a numeral is.
CITATION_ABBREVIATIONS = ("et", "al", "ibid", "eg", "ie", "etc", "cf", "op", "cit", "vol", "no", "pp")
NUMERAL = r"^\d+[a-z]?$"


def stopwords(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, words: the sorted stop words of each text, which are function words, abbreviations of citations, its numerals, and
    names that it mentions ``least`` times. Capitalised words that do not start the text stand for names of persons."""
    numerals = F.filter(F.regexp_extract_all("text", F.lit(r"(?U)\b(\w+)\b"), F.lit(1)), lambda w: w.rlike(NUMERAL))
    mentions = tokens(docs).filter((F.col("pos") > 0) & F.col("token").rlike("^[A-Z][a-z]+$")).groupBy("doc_id", "token").count().filter(F.col("count") >= least)
    names = mentions.groupBy("doc_id").agg(F.collect_set(F.lower("token")).alias("names"))
    base = F.array(*(F.lit(w) for w in (*FUNCTION_WORDS, *CITATION_ABBREVIATIONS)))
    rows = docs.select("doc_id", numerals.alias("numerals")).join(names, "doc_id", "left")
    every = F.concat(base, "numerals", F.coalesce("names", F.array().cast("array<string>")))
    return rows.select("doc_id", F.array_sort(F.array_distinct(every)).alias("words"))
