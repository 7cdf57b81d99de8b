"""Distant reading: where terms stand in a text, next to what, and how evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.words import TOKEN


def positions(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, pos of each token whose stem is a term of its text."""
    return rows.join(terms.select("doc_id", F.col("stem").alias("stem")), ["doc_id", "stem"]).select("doc_id", F.col("stem").alias("term"), "pos")


def with_bins(rows: DataFrame, bins: int, total: str = "n_tokens") -> DataFrame:
    """Bins of equal width: ceil(total / bins), one at least; what is beyond the last falls in it."""
    wide = F.greatest(F.lit(1), F.ceil(F.col(total) / bins))
    return rows.withColumn("bin", F.least(F.floor(F.col("pos") / wide), F.lit(bins - 1)).cast("int"))


def binned_counts(rows: DataFrame, key: str, bins: int) -> DataFrame:
    """Counts of each key in each bin, zeros included: one pass, no join with a table of bins."""
    each = [F.count_if(F.col("bin") == b).alias(f"b{b}") for b in range(bins)]
    wide = rows.groupBy("doc_id", key).agg(*each)
    return wide.select("doc_id", key, F.posexplode(F.array(*(f"b{b}" for b in range(bins)))).alias("bin", "hits"))


def dispersion(rows: DataFrame, key: str, bins: int) -> DataFrame:
    """Frequency, share of the text in percent, and shape of the counts over the bins."""
    counts = binned_counts(rows, key, bins)
    shape = counts.groupBy("doc_id", key).agg(F.sum("hits").alias("freq"), F.coalesce(F.kurtosis("hits"), F.lit(0.0)).alias("kurtosis"), F.coalesce(F.skewness("hits"), F.lit(0.0)).alias("skewness"))
    return shape.filter("freq > 1")


def band_pairs(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Rows of ``a`` with a row of ``b`` at most n places away, not at the same place: a left semi join by text and
    bucket of places, where b is in its own bucket and the two next to it, and not a join of all places."""
    left = a.withColumn("bucket", F.floor(F.col("pos") / n))
    right = b.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.explode(F.expr(f"transform(array(-1, 0, 1), k -> floor(pos / {n}) + k)")).alias("k"))
    near = (F.col("doc_id") == F.col("d")) & (F.col("bucket") == F.col("k")) & (F.abs(F.col("pos") - F.col("p")) <= n) & (F.col("pos") != F.col("p"))
    return left.join(right, near, "left_semi").drop("bucket")


def concordance(docs: DataFrame, hits: DataFrame, width: int, most: int) -> DataFrame:
    """The first hits of each text with the words before and after them, cut out of the text's array of words; only the
    hits are ordered, not the tokens. docs: doc_id, text; hits: doc_id, pos."""
    first = hits.select("doc_id", "pos").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")).filter(F.col("n") <= most)
    rows = docs.select("doc_id", F.expr(f'regexp_extract_all(text, "({TOKEN})", 1)').alias("words")).join(first, "doc_id")
    before = F.slice("words", F.greatest(F.col("pos") - width, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(width)))
    after = F.slice("words", F.col("pos") + 2, F.lit(width))
    return rows.select("doc_id", "pos", F.get("words", F.col("pos")).alias("token"), F.array_join(before, " ").alias("before"), F.array_join(after, " ").alias("after"), "n")


def collocates(tokens: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """How often each word stands within n places of an anchor; a word counts once for each anchor near it."""
    right = anchors.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.explode(F.expr(f"transform(array(-1, 0, 1), k -> floor(pos / {n}) + k)")).alias("k"))
    left = tokens.withColumn("bucket", F.floor(F.col("pos") / n))
    near = (F.col("doc_id") == F.col("d")) & (F.col("bucket") == F.col("k")) & (F.abs(F.col("pos") - F.col("p")) <= n) & (F.col("pos") != F.col("p"))
    return left.join(right, near).groupBy("doc_id", F.col("lower").alias("word")).agg(F.count("*").alias("cnt"))


def term_pool(places: DataFrame, clusters: DataFrame, k: int = 6) -> DataFrame:
    """The k most frequent terms of each cluster."""
    counts = places.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
    named = counts.join(clusters.select("doc_id", F.col("stem").alias("term"), "cluster"), ["doc_id", "term"])
    order = Window.partitionBy("doc_id", "cluster").orderBy(F.desc("cnt"), "first_pos")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
