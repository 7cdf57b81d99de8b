"""Checks of a summary against its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.words import is_function_word, word_array
from lectern.operators import phrases


def content_words(text: Column) -> Column:
    """Distinct lower-cased white-space words, marks kept, whose letters are no function word."""
    words = F.transform(word_array(text), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.regexp_replace(w, "[^a-z]", "") != "") & ~is_function_word(F.regexp_replace(w, "[^a-z]", ""))))


def best_sources(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """For each span the source that holds most of its content words, and the next one's share. By an inverted index of words,
    not by trying all pairs. spans: span_id, text; sources: src_id, text."""
    mine = spans.select("span_id", content_words(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    theirs = sources.select("src_id", F.explode(content_words(F.col("text"))).alias("word"))
    met = mine.select("span_id", "size", F.explode("w").alias("word")).join(theirs, "word").groupBy("span_id", "src_id", "size").agg(F.count("*").alias("shared"))
    met = met.withColumn("overlap", F.col("shared") / F.col("size"))
    order = Window.partitionBy("span_id").orderBy(F.desc("overlap"), "src_id")
    two = met.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 2")
    return two.groupBy("span_id").agg(F.max(F.when(F.col("rank") == 1, F.col("src_id"))).alias("src_id"), F.max(F.when(F.col("rank") == 1, F.col("overlap"))).alias("best"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("overlap"))), F.lit(0.0)).alias("second"))


def coverage(source: DataFrame, summary: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Each cluster's share of hits in a source and in its summary, in percent: OK, WARN beyond the tolerance, DARK
    if the summary has none. Both: doc_id, cluster, hits."""
    both = source.withColumnRenamed("hits", "h1").join(summary.withColumnRenamed("hits", "h2"), ["doc_id", "cluster"], "full").fillna(0, ["h1", "h2"])
    whole = Window.partitionBy("doc_id")
    shares = both.withColumn("target", F.round(F.coalesce(100 * F.col("h1") / F.nullif(F.sum("h1").over(whole), F.lit(0)), F.lit(0.0)), 1)).withColumn("actual", F.round(F.coalesce(100 * F.col("h2") / F.nullif(F.sum("h2").over(whole), F.lit(0)), F.lit(0.0)), 1))
    shares = shares.withColumn("delta", F.round(F.col("actual") - F.col("target"), 1))
    status = F.when((F.col("h1") > 0) & (F.col("h2") == 0), "DARK").when(F.abs("delta") > tolerance, "WARN").otherwise("OK")
    return shares.select("doc_id", "cluster", "target", "actual", "delta", status.alias("status"))


def aligned_hits(source: DataFrame, summary: DataFrame) -> DataFrame:
    """doc_id, cluster, source_hits, summary_hits; what one side lacks is 0. Both: doc_id, cluster, hits."""
    both = source.withColumnRenamed("hits", "source_hits").join(summary.withColumnRenamed("hits", "summary_hits"), ["doc_id", "cluster"], "full")
    return both.fillna(0, ["source_hits", "summary_hits"])


def blocks(rows: DataFrame) -> DataFrame:
    """Lines to blocks: headings and definitions stand alone, other lines up to a blank one make a paragraph."""
    kind = F.when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^\s*Definition\s+\d+"), "defn").when(F.col("line").rlike(r"^\s*\d+\.\d+\s+\S"), "h3").when(F.col("line").rlike(r"^\s*\d+\.?\s+[A-Z]"), "h2").otherwise("p")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("kind", kind).withColumn("new", F.when((F.col("kind") == "p") & (F.lag("kind").over(order) == "p"), 0).otherwise(1))
    rows = rows.withColumn("block", F.sum("new").over(order)).filter("kind <> 'blank'")
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("line"))))
    return rows.groupBy("doc_id", "block", "kind").agg(F.array_join(parts["line"], " ").alias("text"))


def verbatim_runs(items: DataFrame, sources: DataFrame, least: int = 4, most: int = 40) -> DataFrame:
    """doc_id, pos, length of the runs of tokens of each item that a source holds, left to right: at each place the longest
    of at most ``most`` tokens, then on from its end. Both: doc_id, text.

    Shared runs of ``least`` tokens that follow each other in both texts are one longer match, so no other size is
    joined. Texts are known by hashes, as ids may repeat."""
    mine = phrases.grams(items, (least,)).select("doc_id", "pos", "gram")
    theirs = phrases.grams(sources.select(F.xxhash64("text").alias("doc_id"), "text"), (least,)).select(F.col("doc_id").alias("src"), F.col("pos").alias("at"), "gram")
    hits = mine.join(theirs, "gram").select("doc_id", "pos", "src", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    line = Window.partitionBy("doc_id", "src", "diagonal").orderBy("pos")
    islands = hits.withColumn("island", F.col("pos") - F.row_number().over(line))
    end = F.max("pos").over(Window.partitionBy("doc_id", "src", "diagonal", "island")) + least
    longest = islands.withColumn("length", F.least(end - F.col("pos"), F.lit(most))).groupBy("doc_id", "pos").agg(F.max("length").cast("int").alias("length"))
    places = longest.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("places"))
    start = "named_struct('next', 0, 'runs', cast(array() as array<struct<pos: int, length: int>>))"
    step = "if(x.pos >= a.next, named_struct('next', x.pos + x.length, 'runs', concat(a.runs, array(x))), a)"
    return places.select("doc_id", F.explode(F.expr(f"aggregate(places, {start}, (a, x) -> {step}, a -> a.runs)")).alias("run")).select("doc_id", "run.pos", "run.length")


def verbatim_share(items: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, matched, total, share: the tokens of each item that lie in verbatim runs, in percent of all."""
    matched = verbatim_runs(items, sources).groupBy("doc_id").agg(F.sum("length").alias("matched"))
    total = items.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([A-Za-z']+)"), F.lit(1))).cast("long").alias("total"))
    rows = total.join(matched, "doc_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))
    return rows.withColumn("share", F.when(F.col("total") > 0, F.round(100 * F.col("matched") / F.col("total"), 1)).otherwise(0.0))


def best_sentences(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """For each span the sentence of its own source that holds most of its content words: span_id, source, best, second.

    spans: span_id, conv_id, text; sources: conv_id, src_id, source. Spans meet sentences by their words."""
    mine = spans.select("span_id", "conv_id", content_words(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    theirs = sources.select("conv_id", "src_id", F.explode(content_words(F.col("source"))).alias("word"))
    met = mine.select("span_id", "conv_id", "size", F.explode("w").alias("word")).join(theirs, ["conv_id", "word"]).groupBy("span_id", "conv_id", "src_id", "size").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("span_id").orderBy(F.desc("overlap"), "src_id")
    two = met.withColumn("overlap", F.col("shared") / F.col("size")).withColumn("r", F.row_number().over(order)).filter("r <= 2")
    best = two.groupBy("span_id", "conv_id").agg(F.max(F.when(F.col("r") == 1, F.col("src_id"))).alias("src_id"), F.max(F.when(F.col("r") == 1, F.col("overlap"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("overlap"))), F.lit(0.0)).alias("second"))
    return best.join(sources, ["conv_id", "src_id"]).select("span_id", "source", "best", "second")


def normalised(vector: Column) -> Column:
    """A vector of length 1; zeros stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.coalesce(x.cast("double") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
