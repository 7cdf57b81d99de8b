"""Queries of senses, clusters, sources and the incremental log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import clustering, reading, selection, senses, vocabulary
from lectern.plans.basics import UPTO_TOP, docs_of, stemmed_of
from lectern.plans.analysis import CLUSTERS, DENSITY, parts, places_of
from lectern.plans.registry import query
from lectern.session import table
from lectern.sources import files
from lectern.streaming.decisions import latest_choices

#: An inventory of all words: a word's glosses are the next ones of the same two first letters.
RANKED = "ranked AS (SELECT word, left(word, 2) AS letters, row_number() OVER (PARTITION BY left(word, 2) ORDER BY word) AS rank FROM (SELECT DISTINCT lower AS word FROM tokens WHERE regexp_matches(lower, '^[a-z]{4,}$')))"
SENSES = "senses AS (SELECT a.word, s.sense_rank, b.word AS gloss FROM ranked a, (SELECT unnest([0, 1]) AS sense_rank) s JOIN ranked b ON b.letters = a.letters AND b.rank = a.rank + s.sense_rank + 1)"
SCORED = """occ2 AS (SELECT doc_id, sent_id, p AS pos, w AS word FROM (SELECT doc_id, sent_id, unnest(range(len(words))) AS p, unnest(words) AS w FROM dens) SEMI JOIN ranked ON ranked.word = w),
scored AS (SELECT o.doc_id, o.sent_id, o.pos, o.word, s.sense_rank, len(list_filter(d.words, lambda x: x = s.gloss)) - s.sense_rank * CAST(0.5 AS DOUBLE) AS score FROM occ2 o JOIN senses s USING (word) JOIN dens d ON d.doc_id = o.doc_id AND d.sent_id = o.sent_id),
predicted AS (SELECT doc_id, sent_id, pos, word, sense_rank AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, pos ORDER BY score DESC, sense_rank) AS r FROM scored) WHERE r = 1)"""
UPTO_SENSES = W.with_sql("tokens", RANKED, SENSES)
UPTO_SCORES = W.with_sql("tokens", "sentences", DENSITY, RANKED, SENSES, SCORED)


def ranked_words(spark, sf):
    known = W.tokens(docs_of(spark, sf)).filter(F.col("lower").rlike("^[a-z]{4,}$")).select(F.col("lower").alias("word"), F.substring("lower", 1, 2).alias("letters")).distinct()
    return known.withColumn("rank", F.row_number().over(Window.partitionBy("letters").orderBy("word")).cast("long"))


def scores_of(spark, sf):
    rows = selection.densities(docs_of(spark, sf)).select("doc_id", "sent_id", "words")
    words = ranked_words(spark, sf)
    occurrences = rows.select("doc_id", "sent_id", F.posexplode("words").alias("p", "word")).filter(F.col("word").rlike("^[a-z]{4,}$"))
    # A place is that in its sentence, so that a text's places are apart by sentence.
    occurrences = occurrences.select("doc_id", "sent_id", F.col("p").cast("long").alias("pos"), "word")
    return senses.scored(occurrences, senses.inventory(words, "letters"), rows)


def predicted_of(spark, sf):
    scores = scores_of(spark, sf)
    order = Window.partitionBy("doc_id", "sent_id", "pos").orderBy(F.desc("score"), "sense_rank")
    return scores.withColumn("r", F.row_number().over(order)).filter("r = 1").select("doc_id", "sent_id", "pos", "word", F.col("sense_rank").alias("predicted"))


@query("J05_sense_inventory", UPTO_SENSES + "SELECT word, sense_rank, gloss FROM senses")
def j05(spark, sf):
    return senses.inventory(ranked_words(spark, sf), "letters")


@query("M02_gloss_overlap", UPTO_SCORES + "SELECT word, sense_rank, count(*) AS n, round(sum(score), 4) AS total FROM scored GROUP BY ALL")
def m02(spark, sf):
    return scores_of(spark, sf).groupBy("word", "sense_rank").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("L14_withheld_words", UPTO_SCORES + "SELECT doc_id, word, bool_or(predicted <> 0) AS withheld, count(*) AS n FROM predicted GROUP BY ALL")
def l14(spark, sf):
    return senses.withheld(predicted_of(spark, sf)).groupBy("doc_id", "word").agg(F.first("withheld").alias("withheld"), F.count("*").alias("n"))


@query("U05_distinct_mismatches", UPTO_SCORES + "SELECT DISTINCT doc_id, word, predicted FROM predicted WHERE predicted <> 0")
def u05(spark, sf):
    return predicted_of(spark, sf).filter("predicted <> 0").select("doc_id", "word", "predicted").distinct()


@query("H01_decisions", UPTO_SCORES + """, flagged AS (SELECT DISTINCT doc_id, word, predicted FROM predicted WHERE predicted <> 0), decisions AS (SELECT word, CASE rank % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'predicted' ELSE 'delete' END AS kind FROM ranked)
SELECT doc_id, word, predicted, CASE coalesce(kind, 'default') WHEN 'default' THEN 0 ELSE predicted END AS sense FROM flagged LEFT JOIN decisions USING (word) WHERE coalesce(kind, 'default') <> 'delete'""")
def h01(spark, sf):
    kinds = F.when(F.col("rank") % 3 == 0, "default").when(F.col("rank") % 3 == 1, "predicted").otherwise("delete")
    decisions = ranked_words(spark, sf).select("word", kinds.alias("kind"))
    return senses.resolved(u05(spark, sf), decisions).select("doc_id", "word", "predicted", "sense")


@query("J03_purge_deleted", UPTO_SCORES + "SELECT doc_id, sent_id, pos, word FROM predicted ANTI JOIN (SELECT word FROM ranked WHERE rank % 5 = 0) d USING (word)")
def j03(spark, sf):
    gone = ranked_words(spark, sf).filter("rank % 5 = 0").select("word")
    return predicted_of(spark, sf).join(F.broadcast(gone), "word", "left_anti").select("doc_id", "sent_id", "pos", "word")


@query("P11_cluster_sizes", UPTO_TOP.rstrip() + ",\n" + CLUSTERS + " SELECT doc_id, cluster, count(DISTINCT stem) AS n, count(DISTINCT stem) > 6 AS oversized FROM clusters GROUP BY ALL")
def p11(spark, sf):
    _, top = parts(spark, sf)
    return vocabulary.pseudo_clusters(top).groupBy("doc_id", "cluster").agg(F.count_distinct("stem").alias("n")).withColumn("oversized", F.col("n") > 6)


@query("A10_cluster_names", UPTO_TOP.rstrip() + ",\n" + CLUSTERS + """, sums AS (SELECT c.doc_id, c.cluster, s.lower AS word, count(*) AS cnt FROM clusters c JOIN stemmed s USING (doc_id, stem) GROUP BY ALL),
named AS (SELECT doc_id, cluster, string_agg(word, ' & ' ORDER BY word) AS base FROM (SELECT *, rank() OVER (PARTITION BY doc_id, cluster ORDER BY cnt DESC) AS r FROM sums) WHERE r = 1 GROUP BY ALL)
SELECT doc_id, cluster, CASE WHEN k > 1 THEN base || ' (' || k || ')' ELSE base END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY cluster) AS k FROM named)""")
def a10(spark, sf):
    rows, top = parts(spark, sf)
    words = vocabulary.pseudo_clusters(top).join(rows.select("doc_id", "stem", F.col("lower").alias("word")), ["doc_id", "stem"])
    return clustering.cluster_names(words.groupBy("doc_id", "cluster", "word").agg(F.count("*").alias("cnt")))


def term_points(spark, sf):
    """A text's top stems, at most 150, as points: how often each occurs in eight parts of the text."""
    places, _, top, rows = places_of(spark, sf)
    total = rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    counts = reading.binned_counts(reading.with_bins(places.join(total, "doc_id"), 8), "term", 8)
    vectors = counts.groupBy("doc_id", "term").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "hits"))), lambda x: x["hits"].cast("double")).alias("vector"))
    return vectors.join(top.select("doc_id", F.col("stem").alias("term"), F.col("rank").alias("item")), ["doc_id", "term"]).select("doc_id", "item", "vector")


@query("L03_density_clusters")
def l03(spark, sf):
    return clustering.cluster_vectors(term_points(spark, sf), "doc_id")


@query("L04_oversized_resplit")
def l04(spark, sf):
    return clustering.cluster_vectors(term_points(spark, sf), "doc_id", largest=20)


@query("S02_extensions", "SELECT page_id, lower(regexp_extract(url || '.TXT', '\\.([^./\\\\]+)$', 1)) AS kind FROM pages")
def s02(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.extension(F.concat("url", F.lit(".TXT"))).alias("kind"))


@query("S11_tsv_round_trip", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s11(spark, sf):
    path = files.shared_folder(spark, "tsv")
    table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).write.option("sep", "\t").option("header", True).csv(path)
    return spark.read.schema("lang string, n long").option("sep", "\t").option("header", True).csv(path)


@query("S13_json_round_trip", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def s13(spark, sf):
    path = files.shared_folder(spark, "json")
    rows = table(spark, sf, "conversations")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("S07_decision_log", "SELECT 'c' || (user_id % 10) AS corpus, event_type AS phase, 'choice' AS decision_type, arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) AS choice, count(*) AS n FROM events GROUP BY ALL")
def s07(spark, sf):
    path = files.shared_folder(spark, "log")
    rows = table(spark, sf, "events").select(F.concat(F.lit("c"), F.col("user_id") % 10).alias("corpus"), F.col("event_type").alias("phase"), F.lit("choice").alias("decision_type"), F.col("event_id").cast("string").alias("choice"), (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, event_id / 1e9)")).alias("timestamp"), "event_id", "ts")
    rows.write.json(path)
    back = spark.read.schema(files.DECISION + ", event_id long, ts timestamp").json(path)
    return back.groupBy("corpus", "phase", "decision_type").agg(F.max_by("choice", F.struct("ts", "event_id")).alias("choice"), F.count("*").alias("n"))


@query("S08_rates_in_names", "SELECT 'corpus' || doc_id AS corpus, CAST(10 + doc_id % 3 AS INT) AS rate FROM documents")
def s08(spark, sf):
    name = F.concat(F.lit("/data/corpus"), "doc_id", F.lit("/corpus-condensed-"), (10 + F.col("doc_id") % 3).cast("string"), F.lit("pct.txt"))
    return files.rates(docs_of(spark, sf).select(name.alias("path")))


@query("X01_incremental_log", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS choice, count(*) AS n FROM events GROUP BY ALL")
def x01(spark, sf):
    base = files.shared_folder(spark, "stream")
    rows = table(spark, sf, "events")
    rows.repartition(3, "event_id").write.parquet(f"{base}/in")
    return latest_choices(spark, f"{base}/in", rows.schema, ["user_id", "event_type"], "event_id", ["ts", "event_id"], f"{base}/out", f"{base}/state")
