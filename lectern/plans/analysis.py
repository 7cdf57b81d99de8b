"""Queries of distant reading, sentence selection and checks of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.functions.porter import stems_sql
from lectern.operators import phrases, reading, selection, verification, vocabulary, whole
from lectern.plans.basics import OCCURRENCES, STEM_COUNTS, STEMMED, STOP, UPTO_TOP, docs_of, grams_sql, stemmed_of
from lectern.plans.registry import query
from lectern.session import table

UPTO = UPTO_TOP.rstrip() + ",\n"
CLUSTERS = "clusters AS (SELECT doc_id, stem, rank, 'cluster_' || (rank % 3) AS cluster FROM top)"
N_TOKENS = "n_tokens AS (SELECT doc_id, count(*) AS n_tokens FROM tokens GROUP BY doc_id)"
DENSITY = f"""dens AS (SELECT *, CASE WHEN len(words) > 0 THEN CAST(len(list_filter(words, lambda x: regexp_matches(x, '^[a-z]+$') AND x NOT IN ({STOP}))) AS DOUBLE) / len(words) ELSE 0.0 END AS density
  FROM (SELECT *, regexp_extract_all(lower(sentence), '[A-Za-z'']+') AS words FROM sentences))"""


def parts(spark, sf):
    rows = stemmed_of(spark, sf)
    top = vocabulary.rank_cut(vocabulary.stem_counts(rows), 0.9, 150)
    return rows, top


def places_of(spark, sf):
    rows, top = parts(spark, sf)
    return reading.positions(rows.filter(F.col("lower").rlike("^[a-z]+$")), top), vocabulary.pseudo_clusters(top), top, rows


@query("A07_lexical_density", W.with_sql("sentences", DENSITY) + "SELECT doc_id, sent_id, density FROM dens")
def a07(spark, sf):
    return selection.densities(docs_of(spark, sf)).select("doc_id", "sent_id", "density")


@query("A08_density_threshold", W.with_sql("sentences", DENSITY) + "SELECT doc_id, quantile_cont(density, 0.5) AS threshold FROM dens GROUP BY doc_id")
def a08(spark, sf):
    return selection.density_thresholds(selection.densities(docs_of(spark, sf)), 0.5)


@query("P08_dense_sentences", W.with_sql("sentences", DENSITY) + "SELECT doc_id, sent_id FROM dens JOIN (SELECT doc_id, quantile_cont(density, 0.75) AS t FROM dens GROUP BY doc_id) USING (doc_id) WHERE density >= t")
def p08(spark, sf):
    rows = selection.densities(docs_of(spark, sf))
    return rows.join(selection.density_thresholds(rows, 0.75), "doc_id").filter("density >= threshold").select("doc_id", "sent_id")


@query("W06_informative_sentences", UPTO + CLUSTERS + ", " + W.SQL["sentences"] + ", " + DENSITY + f""", chosen AS (SELECT d.* FROM dens d JOIN (SELECT doc_id, quantile_cont(density, 0.5) AS t FROM dens GROUP BY doc_id) USING (doc_id) WHERE density >= t),
swords AS (SELECT doc_id, sent_id, density, unnest(words) AS lower FROM chosen), {stems_sql("swords").replace("stems AS", "sstems AS")},
found AS (SELECT doc_id, cluster, sent_id, first(density) AS density, list_sort(list(DISTINCT stem)) AS stems FROM swords JOIN sstems USING (lower) JOIN clusters USING (doc_id, stem) GROUP BY ALL),
scored AS (SELECT *, round(density * (1 + len(stems)), 4) AS score FROM found)
SELECT doc_id, cluster, sent_id, score, array_to_string(stems, ' ') AS stems, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY score DESC, sent_id) AS rank FROM scored) WHERE rank <= 3""".replace("GROUP BY ALL),\nscored", "GROUP BY doc_id, cluster, sent_id),\nscored"))
def w06(spark, sf):
    texts, clusters = texts_and_clusters(spark, sf)
    found = selection.informative(selection.dense_sentences(texts, 0.5), whole.clusters_of_words(clusters), 3)
    return found.select("doc_id", "cluster", "sent_id", "score", F.array_join("stems", " ").alias("stems"), "rank")


def texts_and_clusters(spark, sf):
    """Texts dealt by doc_id, and their top words with clusters."""
    texts = whole.dealt(docs_of(spark, sf))
    return texts, whole.top_words(texts, 0.9, 150)


PHRASES = """sg AS (SELECT doc_id, sent_id, n, p, array_to_string(words[p + 1:p + n], ' ') AS gram FROM (SELECT doc_id, sent_id, n, words, unnest(range(0, len(words) - n + 1)) AS p FROM dens, (SELECT unnest([2, 3]) AS n) WHERE len(words) >= n)),
sc AS (SELECT doc_id, n, gram, count(*) AS cnt, min((sent_id, p)) AS first FROM sg GROUP BY ALL HAVING count(*) >= 2), so AS (SELECT sc.* FROM sc JOIN (SELECT doc_id, quantile_cont(cnt, 0.95) AS t FROM sc GROUP BY doc_id) USING (doc_id) WHERE cnt >= t),
sw AS (SELECT DISTINCT doc_id, gram, unnest(string_split(gram, ' ')) AS w FROM so), near AS (SELECT DISTINCT c.doc_id, cluster, gram FROM sw JOIN clusters c USING (doc_id) WHERE starts_with(w, stem) OR starts_with(stem, w)),
sizes AS (SELECT doc_id, cluster, count(DISTINCT stem) AS k FROM clusters GROUP BY ALL),
phrases AS (SELECT doc_id, cluster, gram, cnt, rank FROM (SELECT near.*, cnt, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY cnt DESC, n DESC, first) AS rank FROM near JOIN so USING (doc_id, gram)) JOIN sizes USING (doc_id, cluster) WHERE rank <= k)"""


@query("A05_cluster_phrases", UPTO + CLUSTERS + ", " + W.SQL["sentences"] + ", " + DENSITY + ", " + PHRASES + " SELECT doc_id, cluster, gram, cnt, rank FROM phrases")
def a05(spark, sf):
    texts, clusters = texts_and_clusters(spark, sf)
    return selection.cluster_phrases(selection.sentence_grams(texts), clusters).drop("sent_ids")


@query("F30_scores_with_phrases", UPTO + CLUSTERS + ", " + W.SQL["sentences"] + ", " + DENSITY + ", " + PHRASES + f""", chosen AS (SELECT d.* FROM dens d JOIN (SELECT doc_id, quantile_cont(density, 0.5) AS t FROM dens GROUP BY doc_id) USING (doc_id) WHERE density >= t),
swords AS (SELECT doc_id, sent_id, density, unnest(words) AS lower FROM chosen), {stems_sql("swords").replace("stems AS", "sstems AS")},
found AS (SELECT doc_id, cluster, sent_id, first(density) AS density, count(DISTINCT stem) AS n_stems FROM swords JOIN sstems USING (lower) JOIN clusters USING (doc_id, stem) GROUP BY doc_id, cluster, sent_id),
hits AS (SELECT doc_id, cluster, sent_id, count(*) AS n_phrases FROM (SELECT DISTINCT doc_id, sent_id, gram FROM sg) JOIN phrases USING (doc_id, gram) GROUP BY doc_id, cluster, sent_id),
scored AS (SELECT *, round(density * (1 + n_stems + coalesce(n_phrases, 0)), 4) AS score FROM found LEFT JOIN hits USING (doc_id, cluster, sent_id))
SELECT doc_id, cluster, sent_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY score DESC, sent_id) AS rank FROM scored) WHERE rank <= 3""")
def f30(spark, sf):
    texts, clusters = texts_and_clusters(spark, sf)
    hits = selection.phrase_hits(selection.cluster_phrases(selection.sentence_grams(texts), clusters))
    return selection.informative(selection.dense_sentences(texts, 0.5), whole.clusters_of_words(clusters), 3, hits).select("doc_id", "cluster", "sent_id", "score", "rank")


SUMMARY = DENSITY + """, picked AS (SELECT * FROM (SELECT *, sum(len(words)) OVER (PARTITION BY doc_id) * 0.25 AS target, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY density DESC, sent_id ROWS UNBOUNDED PRECEDING) AS running FROM dens) WHERE running <= target)"""


@query("M05_extractive_condensation", W.with_sql("sentences", SUMMARY) + "SELECT doc_id, sent_id, density FROM picked")
def m05(spark, sf):
    return selection.condensed(selection.densities(docs_of(spark, sf)), 0.25).select("doc_id", "sent_id", "density")


@query("J14_phrases_in_sentences", "WITH " + grams_sql(3, 3) + ", " + W.SQL["sentences"] + """, sg AS (SELECT DISTINCT doc_id, sent_id, array_to_string(w[p + 1:p + 3], ' ') AS gram FROM (SELECT doc_id, sent_id, w, unnest(range(0, len(w) - 2)) AS p
 FROM (SELECT doc_id, sent_id, regexp_extract_all(lower(sentence), '[A-Za-z'']+') AS w FROM sentences) WHERE len(w) >= 3)) SELECT doc_id, sent_id, gram FROM sg JOIN gram_counts USING (doc_id, gram)""")
def j14(spark, sf):
    counts = phrases.gram_counts(phrases.grams(docs_of(spark, sf), range(3, 4)))
    rows = W.sentences(docs_of(spark, sf)).select(F.struct("doc_id", "sent_id").alias("doc_id"), F.col("sentence").alias("text"))
    inside = phrases.grams(rows, range(3, 4)).select("doc_id.doc_id", "doc_id.sent_id", "gram").distinct()
    return inside.join(counts.select("doc_id", "gram"), ["doc_id", "gram"]).select("doc_id", "sent_id", "gram")


BINNED = "binned AS (SELECT o.doc_id, o.stem AS term, least(floor(pos / greatest(1, ceil(n_tokens / CAST({bins} AS DOUBLE)))), {last}) AS bin FROM occ o JOIN n_tokens USING (doc_id))"


@query("A18_cluster_trend", UPTO + CLUSTERS + ", " + OCCURRENCES + ", " + N_TOKENS + ", " + BINNED.format(bins=5, last=4) + """, dense AS (SELECT DISTINCT doc_id, cluster, CAST(unnest(range(5)) AS INT) AS bin FROM clusters)
SELECT d.doc_id, d.cluster, d.bin, count(b.bin) AS hits FROM dense d JOIN clusters c ON c.doc_id = d.doc_id AND c.cluster = d.cluster LEFT JOIN binned b ON b.doc_id = d.doc_id AND b.term = c.stem AND b.bin = d.bin GROUP BY ALL""")
def a18(spark, sf):
    places, clusters, _, rows = places_of(spark, sf)
    total = rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    named = places.join(clusters.withColumnRenamed("stem", "term"), ["doc_id", "term"]).join(total, "doc_id")
    return reading.binned_counts(reading.with_bins(named, 5), "cluster", 5).withColumn("hits", F.col("hits").cast("long"))


@query("A19_term_dispersion", UPTO + OCCURRENCES + ", " + N_TOKENS + ", " + BINNED.format(bins=8, last=7) + """, dense AS (SELECT DISTINCT doc_id, term, unnest(range(8)) AS bin FROM binned),
hits AS (SELECT d.doc_id, d.term, d.bin, count(b.bin) AS h FROM dense d LEFT JOIN binned b USING (doc_id, term, bin) GROUP BY ALL),
means AS (SELECT *, avg(h) OVER (PARTITION BY doc_id, term) AS m FROM hits)
SELECT doc_id, term, CAST(sum(h) AS BIGINT) AS freq, round(CASE WHEN avg(power(h - m, 2)) = 0 THEN 0.0 ELSE avg(power(h - m, 4)) / power(avg(power(h - m, 2)), 2) - 3 END, 6) AS kurtosis,
 round(CASE WHEN avg(power(h - m, 2)) = 0 THEN 0.0 ELSE avg(power(h - m, 3)) / power(avg(power(h - m, 2)), 1.5) END, 6) AS skewness FROM means GROUP BY doc_id, term HAVING sum(h) > 1""")
def a19(spark, sf):
    places, _, _, rows = places_of(spark, sf)
    total = rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    shape = reading.dispersion(reading.with_bins(places.join(total, "doc_id"), 8), "term", 8)
    return shape.select("doc_id", "term", F.col("freq").cast("long").alias("freq"), F.round("kurtosis", 6).alias("kurtosis"), F.round("skewness", 6).alias("skewness"))


@query("W07_concordance", UPTO + OCCURRENCES + """, hits AS (SELECT o.doc_id, o.pos FROM occ o JOIN top t USING (doc_id, stem) WHERE t.rank = 1),
kwic AS (SELECT doc_id, pos, token, array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), ' ') AS before, array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), ' ') AS after FROM tokens)
SELECT doc_id, pos, token, coalesce(before, '') AS before, coalesce(after, '') AS after, n FROM (SELECT k.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM kwic k SEMI JOIN hits USING (doc_id, pos)) WHERE n <= 25""")
def w07(spark, sf):
    rows, top = parts(spark, sf)
    hits = reading.positions(rows.filter(F.col("lower").rlike("^[a-z]+$")), top.filter("rank = 1"))
    return reading.concordance(docs_of(spark, sf), hits, 8, 25)


@query("A21_collocates", UPTO + OCCURRENCES + f""", hits AS (SELECT o.doc_id, o.pos FROM occ o JOIN top t USING (doc_id, stem) WHERE t.rank = 1),
near AS (SELECT h.doc_id, h.pos, unnest(range(h.pos - 5, h.pos + 6)) AS p FROM hits h)
SELECT t.doc_id, t.lower AS word, count(*) AS cnt FROM tokens t JOIN near n ON n.doc_id = t.doc_id AND n.p = t.pos AND n.pos <> t.pos WHERE regexp_matches(t.lower, '^[a-z]+$') AND t.lower NOT IN ({STOP}) GROUP BY ALL""")
def a21(spark, sf):
    rows, top = parts(spark, sf)
    anchors = reading.positions(rows.filter(F.col("lower").rlike("^[a-z]+$")), top.filter("rank = 1"))
    return reading.collocates(W.tokens(docs_of(spark, sf)).filter(vocabulary.is_content()), anchors, 5)


@query("J18_band_semi_join", UPTO + OCCURRENCES + """, a AS (SELECT o.doc_id, o.pos FROM occ o JOIN top t USING (doc_id, stem) WHERE t.rank = 1), b AS (SELECT o.doc_id, o.pos FROM occ o JOIN top t USING (doc_id, stem) WHERE t.rank = 2)
SELECT doc_id, count(*) AS hits FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND abs(a.pos - b.pos) <= 10 AND a.pos <> b.pos) GROUP BY doc_id""")
def j18(spark, sf):
    rows, top = parts(spark, sf)
    plain = rows.filter(F.col("lower").rlike("^[a-z]+$"))
    near = reading.band_pairs(reading.positions(plain, top.filter("rank = 1")), reading.positions(plain, top.filter("rank = 2")), 10)
    return near.groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("J19_band_rows", UPTO + OCCURRENCES + """, a AS (SELECT o.doc_id, o.pos FROM occ o JOIN top t USING (doc_id, stem) WHERE t.rank = 2), b AS (SELECT o.doc_id, o.pos FROM occ o JOIN top t USING (doc_id, stem) WHERE t.rank = 1)
SELECT doc_id, pos FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND abs(a.pos - b.pos) <= 10 AND a.pos <> b.pos)""")
def j19(spark, sf):
    rows, top = parts(spark, sf)
    plain = rows.filter(F.col("lower").rlike("^[a-z]+$"))
    return reading.band_pairs(reading.positions(plain, top.filter("rank = 2")), reading.positions(plain, top.filter("rank = 1")), 10).select("doc_id", "pos")


POOL = """pool AS (SELECT * FROM (SELECT p.doc_id, p.stem AS term, c.cluster, p.cnt, p.first_pos, row_number() OVER (PARTITION BY p.doc_id, c.cluster ORDER BY p.cnt DESC, p.first_pos) AS rank
  FROM (SELECT doc_id, stem, count(*) AS cnt, min(pos) AS first_pos FROM occ GROUP BY ALL) p JOIN clusters c USING (doc_id, stem)) WHERE rank <= 6)"""


@query("A40_term_pool", UPTO + CLUSTERS + ", " + OCCURRENCES + ", " + POOL + " SELECT doc_id, term, cluster, cnt, rank FROM pool")
def a40(spark, sf):
    places, clusters, _, _ = places_of(spark, sf)
    return reading.term_pool(places, clusters).select("doc_id", "term", "cluster", "cnt", "rank")


@query("J17_collocation_pairs", UPTO + CLUSTERS + ", " + OCCURRENCES + ", " + POOL + """, pl AS (SELECT o.doc_id, o.stem AS term, o.pos FROM occ o JOIN pool p ON p.doc_id = o.doc_id AND p.term = o.stem),
med AS (SELECT doc_id, list_sort(list(cnt))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM pool GROUP BY doc_id),
pairs AS (SELECT a.doc_id, a.term AS term_a, a.cluster AS cluster_a, a.cnt AS cnt_a, b.term AS term_b, b.cluster AS cluster_b, b.cnt AS cnt_b FROM pool a JOIN pool b ON a.doc_id = b.doc_id AND a.cluster < b.cluster),
near AS (SELECT x.doc_id, x.term AS term_a, y.term AS term_b, count(DISTINCT x.pos) AS hits FROM (SELECT *, unnest(range(pos - 10, pos + 11)) AS q FROM pl) x JOIN pl y ON y.doc_id = x.doc_id AND y.pos = x.q AND y.pos <> x.pos GROUP BY ALL)
SELECT doc_id, term_a, cluster_a, term_b, cluster_b, hits, greatest(cnt_a, cnt_b) >= 5 * median AS confounded FROM pairs JOIN near USING (doc_id, term_a, term_b) JOIN med USING (doc_id)""")
def j17(spark, sf):
    return collocations_of(spark, sf).select("doc_id", "term_a", "cluster_a", "term_b", "cluster_b", "hits", "confounded")


def collocations_of(spark, sf):
    return whole.collocation_pairs(whole.dealt(docs_of(spark, sf)), 0.9, 150, 10)


@query("O16_word_cloud_table", W.with_sql("tokens") + f"SELECT lower AS word, count(*) AS cnt FROM tokens WHERE regexp_matches(lower, '^[a-z]+$') AND lower NOT IN ({STOP}) GROUP BY lower ORDER BY cnt DESC, word LIMIT 100")
def o16(spark, sf):
    counts = W.tokens(docs_of(spark, sf)).filter(vocabulary.is_content()).groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "word").limit(100)


@query("W16_character_budget", W.with_sql("tokens") + "SELECT doc_id, count(*) AS kept FROM (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(token) AS before FROM tokens) WHERE before < 500 GROUP BY doc_id")
def w16(spark, sf):
    from pyspark.sql import Window

    before = F.sum(F.length("token")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.length("token")
    return W.tokens(docs_of(spark, sf)).withColumn("before", before).filter("before < 500").groupBy("doc_id").agg(F.count("*").alias("kept"))


CONTENT_WORDS = f"""list_distinct(list_filter(list_transform({W.word_array_sql('text')}, lambda x: lower(x)), lambda x: regexp_replace(x, '[^a-z]', '', 'g') <> '' AND regexp_replace(x, '[^a-z]', '', 'g') NOT IN ({STOP})))"""


@query("J16_best_source", f"""WITH mine AS (SELECT item_id AS span_id, {CONTENT_WORDS} AS w FROM benchmark), theirs AS (SELECT doc_id AS src_id, unnest({CONTENT_WORDS}) AS word FROM documents),
met AS (SELECT span_id, src_id, CAST(count(*) AS DOUBLE) / len(w) AS overlap FROM (SELECT span_id, w, unnest(w) AS word FROM mine) JOIN theirs USING (word) GROUP BY span_id, src_id, w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY overlap DESC, src_id) AS r FROM met)
SELECT span_id, max(CASE WHEN r = 1 THEN src_id END) AS src_id, max(CASE WHEN r = 1 THEN overlap END) AS best, coalesce(max(CASE WHEN r = 2 THEN overlap END), 0.0) AS second FROM ranked GROUP BY span_id""")
def j16(spark, sf):
    spans = table(spark, sf, "benchmark").select(F.col("item_id").alias("span_id"), "text")
    return verification.best_sources(spans, docs_of(spark, sf).withColumnRenamed("doc_id", "src_id"))


HITS = "src AS (SELECT doc_id, cluster, count(*) AS h1 FROM occ JOIN clusters USING (doc_id, stem) GROUP BY ALL)"


def cluster_hits(spark, sf):
    """Hits of each cluster in each source, and in its summary."""
    places, clusters, _, rows = places_of(spark, sf)
    named = clusters.withColumnRenamed("stem", "term")
    source = places.join(named, ["doc_id", "term"]).groupBy("doc_id", "cluster").agg(F.count("*").alias("hits"))
    words = selection.condensed(selection.densities(docs_of(spark, sf)), 0.25).select("doc_id", F.explode("words").alias("lower"))
    known = rows.select("lower", "stem").distinct()
    summary = words.filter(F.col("lower").rlike("^[a-z]+$")).join(known, "lower").join(clusters, ["doc_id", "stem"]).groupBy("doc_id", "cluster").agg(F.count("*").alias("hits"))
    return source, summary


@query("A16_coverage", UPTO + CLUSTERS + ", " + OCCURRENCES + ", " + HITS + ", " + W.SQL["sentences"] + ", " + SUMMARY + f""", pw AS (SELECT doc_id, unnest(words) AS lower FROM picked), smy AS (SELECT doc_id, cluster, count(*) AS h2 FROM pw JOIN stems USING (lower) JOIN clusters USING (doc_id, stem) WHERE regexp_matches(lower, '^[a-z]+$') GROUP BY ALL),
both_ AS (SELECT doc_id, cluster, coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2 FROM src FULL JOIN smy USING (doc_id, cluster)),
shares AS (SELECT *, round(coalesce(100 * h1 / nullif(CAST(sum(h1) OVER w AS DOUBLE), 0), 0.0), 1) AS target, round(coalesce(100 * h2 / nullif(CAST(sum(h2) OVER w AS DOUBLE), 0), 0.0), 1) AS actual FROM both_ WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, cluster, target, actual, round(actual - target, 1) AS delta, CASE WHEN h1 > 0 AND h2 = 0 THEN 'DARK' WHEN abs(round(actual - target, 1)) > 5 THEN 'WARN' ELSE 'OK' END AS status FROM shares""")
def a16(spark, sf):
    return verification.coverage(*cluster_hits(spark, sf))


@query("J28_aligned_cluster_hits", UPTO + CLUSTERS + ", " + OCCURRENCES + ", " + HITS + ", " + W.SQL["sentences"] + ", " + SUMMARY + """, pw AS (SELECT doc_id, unnest(words) AS lower FROM picked), smy AS (SELECT doc_id, cluster, count(*) AS h2 FROM pw JOIN stems USING (lower) JOIN clusters USING (doc_id, stem) WHERE regexp_matches(lower, '^[a-z]+$') GROUP BY ALL)
SELECT doc_id, cluster, coalesce(h1, 0) AS source_hits, coalesce(h2, 0) AS summary_hits FROM src FULL JOIN smy USING (doc_id, cluster)""")
def j28_clusters(spark, sf):
    return verification.aligned_hits(*cluster_hits(spark, sf))


_RUNS = """WITH RECURSIVE d AS (SELECT DISTINCT text FROM documents), dw AS (SELECT text AS src, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM d), iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM benchmark),
dg AS (SELECT src, p, array_to_string(w[p + 1:p + 4], ' ') AS gram FROM (SELECT src, w, unnest(range(0, len(w) - 3)) AS p FROM dw)), ig AS (SELECT item_id, p, array_to_string(w[p + 1:p + 4], ' ') AS gram FROM (SELECT item_id, w, unnest(range(0, len(w) - 3)) AS p FROM iw)),
hits AS (SELECT DISTINCT item_id, md5(src) AS src, ig.p AS pos, ig.p - dg.p AS diagonal FROM ig JOIN dg USING (gram)),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY item_id, src, diagonal ORDER BY pos) AS island FROM hits),
longest AS (SELECT item_id, pos, max(least(stop - pos, 40)) AS length FROM (SELECT *, max(pos) OVER (PARTITION BY item_id, src, diagonal, island) + 4 AS stop FROM islands) GROUP BY ALL),
next AS (SELECT a.item_id, a.pos, a.length, min(b.pos) AS onward FROM longest a LEFT JOIN longest b ON b.item_id = a.item_id AND b.pos >= a.pos + a.length GROUP BY ALL),
runs AS (SELECT item_id, pos, length, onward FROM next WHERE (item_id, pos) IN (SELECT (item_id, min(pos)) FROM longest GROUP BY item_id) UNION ALL SELECT n.item_id, n.pos, n.length, n.onward FROM runs r JOIN next n ON n.item_id = r.item_id AND n.pos = r.onward)
"""


@query("L01_verbatim_runs", _RUNS + "SELECT item_id, CAST(pos AS INT) AS pos, CAST(length AS INT) AS length FROM runs")
def l01_runs(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return verification.verbatim_runs(items, docs_of(spark, sf)).withColumnRenamed("doc_id", "item_id")


@query("A17_verbatim_share", _RUNS + """, totals AS (SELECT item_id, len(w) AS total FROM iw), got AS (SELECT item_id, sum(length) AS matched FROM runs GROUP BY item_id)
SELECT item_id, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, CASE WHEN total > 0 THEN round(100 * coalesce(matched, 0) / total, 1) ELSE 0.0 END AS share FROM totals LEFT JOIN got USING (item_id)""")
def a17(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return verification.verbatim_share(items, docs_of(spark, sf)).withColumnRenamed("doc_id", "item_id")


@query("F22_blocks", W.with_sql("lines") + r"""SELECT doc_id, CAST(block AS BIGINT) AS block, kind, string_agg(trim(line), ' ' ORDER BY line_no) AS text FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM
 (SELECT *, CASE WHEN kind = 'p' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = 'p' THEN 0 ELSE 1 END AS new FROM
 (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*Definition\s+\d+') THEN 'defn' WHEN regexp_matches(line, '^\s*\d+\.\d+\s+\S') THEN 'h3' WHEN regexp_matches(line, '^\s*\d+\.?\s+[A-Z]') THEN 'h2' ELSE 'p' END AS kind FROM lines))) WHERE kind <> 'blank' GROUP BY ALL""")
def f22(spark, sf):
    return verification.blocks(W.lines(docs_of(spark, sf)))


@query("A26_longest_word", f"SELECT doc_id, list_max(list_transform({W.word_array_sql('text')}, lambda x: length(x))) AS longest FROM documents")
def a26(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.array_max(F.transform(W.word_array(F.col("text")), F.length)).cast("long").alias("longest"))


@query("A27_mean_words_a_sentence", W.with_sql("sentences") + f"SELECT doc_id, greatest(1, CAST(round(sum(len(regexp_extract_all(sentence, '[A-Za-z'']+'))) / CAST(count(*) AS DOUBLE)) AS BIGINT)) AS mean_words FROM sentences GROUP BY doc_id")
def a27(spark, sf):
    rows = selection.densities(docs_of(spark, sf))
    return rows.groupBy("doc_id").agg(F.greatest(F.lit(1), F.round(F.sum(F.size("words")) / F.count("*"))).cast("long").alias("mean_words"))


@query("W10_unknown_word_run", W.with_sql("tokens") + f""", known AS (SELECT lower FROM tokens GROUP BY lower HAVING count(*) >= 20 UNION SELECT unnest([{STOP}])),
flagged AS (SELECT t.doc_id, t.pos, k.lower IS NULL AS unknown FROM tokens t LEFT JOIN (SELECT DISTINCT lower FROM known) k USING (lower)),
islands AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id, unknown ORDER BY pos) AS island, unknown FROM flagged)
SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, island, count(*) AS n FROM islands WHERE unknown GROUP BY ALL) GROUP BY doc_id""")
def w10(spark, sf):
    from pyspark.sql import Window

    rows = W.tokens(docs_of(spark, sf))
    often = rows.groupBy("lower").agg(F.count("*").alias("n")).filter("n >= 20").select("lower")
    unknown = rows.filter(~W.is_function_word(F.col("lower"))).join(often, "lower", "left_anti")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return unknown.withColumn("island", island).groupBy("doc_id", "island").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("longest"))
