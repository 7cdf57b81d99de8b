"""Lexical density of sentences, and the most informative sentences of each cluster of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.words import TOKEN, is_function_word, sentence_array, sentences
from lectern.operators.phrases import recurring_grams


def densities(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, sentence, words (lower-cased tokens), density: share of words that are no function words."""
    rows = sentences(docs).withColumn("words", F.expr(f"regexp_extract_all(lower(sentence), \"({TOKEN})\", 1)"))
    content = F.filter("words", lambda w: w.rlike("^[a-z]+$") & ~is_function_word(w))
    return rows.withColumn("density", F.when(F.size("words") > 0, F.size(content) / F.size("words")).otherwise(0.0))


def density_thresholds(rows: DataFrame, share: float) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.percentile("density", share).alias("threshold"))


def dense_sentences(texts: DataFrame, share: float) -> DataFrame:
    """doc_id, sent_id, words, density of the sentences at or above the percentile of their text, texts being dealt by doc_id."""
    rows = densities(texts).select("doc_id", "sent_id", "words", "density")
    threshold = F.percentile("density", share).over(Window.partitionBy("doc_id"))
    return rows.withColumn("threshold", threshold).filter("density >= threshold").drop("threshold")


def informative(dense: DataFrame, named: DataFrame, k: int, phrases: DataFrame | None = None) -> DataFrame:
    """For each cluster the k sentences with the highest density x (1 + stems of the cluster in it + its phrases there).
    Sentences meet a map of their text's words, so no sentence is tried with every cluster, and all that is dealt is dealt
    by text. dense: of ``dense_sentences``; named: doc_id and a map from words to cluster and stem; phrases: doc_id, cluster,
    sent_id, n_phrases."""
    met = F.expr("array_distinct(filter(transform(words, w -> named[w]), x -> x is not null))")
    found = dense.join(named, "doc_id").select("doc_id", "sent_id", "density", F.explode(met).alias("x")).select("doc_id", "sent_id", "density", "x.cluster", "x.stem", F.lit(None).cast("long").alias("n_phrases"))
    if phrases is not None:  # by a group and not by a join, so that rows stay where they are
        found = found.unionByName(phrases.select("doc_id", "sent_id", F.lit(None).cast("double").alias("density"), "cluster", F.lit(None).cast("string").alias("stem"), "n_phrases"))
    scored = found.groupBy("doc_id", "cluster", "sent_id").agg(F.first("density", ignorenulls=True).alias("density"), F.array_sort(F.collect_set("stem")).alias("stems"), F.coalesce(F.max("n_phrases"), F.lit(0)).alias("n_phrases"))
    scored = scored.filter("density is not null").withColumn("score", F.round(F.col("density") * (1 + F.size("stems") + F.col("n_phrases")), 4))
    order = Window.partitionBy("doc_id", "cluster").orderBy(F.desc("score"), "sent_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def sentence_grams(texts: DataFrame, sizes: range = range(2, 4)) -> DataFrame:
    """doc_id, sent_id, n, place, gram of the runs of words within sentences that may recur in their text."""
    runs = F.transform(sentence_array(F.col("text")), lambda s: F.regexp_extract_all(F.lower(s), F.lit(f"({TOKEN})"), F.lit(1)))
    return recurring_grams(texts.select("doc_id", runs.alias("runs")), sizes).withColumnRenamed("run", "sent_id")


def cluster_phrases(grams: DataFrame, clusters: DataFrame, share: float = 0.95, least: int = 2) -> DataFrame:
    """doc_id, cluster, gram, cnt, rank, sent_ids: phrases of each cluster, as many as it has stems at most, and where they are.

    A phrase counts ``least`` times (2 or more) and as often as the percentile of its text's repeated phrases says, and one of
    its words is a stem of the cluster or either is the start of the other. grams: of ``sentence_grams``."""
    counts = grams.groupBy("doc_id", "n", "gram").agg(F.count("*").alias("cnt"), F.min(F.struct("sent_id", "place")).alias("first"), F.collect_set("sent_id").alias("sent_ids")).filter(F.col("cnt") >= least)
    often = counts.withColumn("t", F.percentile("cnt", share).over(Window.partitionBy("doc_id"))).filter("cnt >= t").drop("t")
    stems = clusters.groupBy("doc_id", "cluster").agg(F.collect_set("stem").alias("stems"))
    near = F.exists(F.split("gram", " "), lambda w: F.exists("stems", lambda s: F.startswith(w, s) | F.startswith(s, w)))
    named = often.join(stems, "doc_id").filter(near)
    order = Window.partitionBy("doc_id", "cluster").orderBy(F.desc("cnt"), F.desc("n"), "first")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= F.size("stems"))
    return ranked.select("doc_id", "cluster", "gram", "cnt", "rank", "sent_ids")


def phrase_hits(phrases: DataFrame) -> DataFrame:
    """doc_id, cluster, sent_id, n_phrases: how many of a cluster's phrases each sentence holds."""
    return phrases.select("doc_id", "cluster", F.explode("sent_ids").alias("sent_id")).groupBy("doc_id", "cluster", "sent_id").agg(F.count("*").alias("n_phrases"))


def condensed(rows: DataFrame, share: float) -> DataFrame:
    """The default condenser: sentences by density while their words fit the share of the text's words."""
    sized = rows.withColumn("n", F.size("words"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("density"), "sent_id")
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("target", total * share).withColumn("running", running).filter("running <= target").select("doc_id", "sent_id", "sentence", "words", "density")
