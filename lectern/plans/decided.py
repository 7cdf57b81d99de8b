"""Queries of reviewers' decisions, windows around words, budgets and top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import phrases, reading, reviews, selection, vocabulary
from lectern.plans.analysis import CLUSTERS, DENSITY, PHRASES, POOL, collocations_of, parts, places_of, texts_and_clusters
from lectern.plans.audits import CALLS_SQL, calls
from lectern.plans.basics import OCCURRENCES, UPTO_TOP, docs_of, grams_sql
from lectern.plans.registry import query
from lectern.session import table
from lectern.sources import files

UPTO = UPTO_TOP.rstrip() + ",\n" + CLUSTERS
LISTS = "lists AS (SELECT doc_id, cluster, list(stem ORDER BY rank) AS stems FROM clusters GROUP BY doc_id, cluster)"


def lists_of(spark, sf):
    _, top = parts(spark, sf)
    rows = vocabulary.pseudo_clusters(top).groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "stem")))["stem"].alias("stems"))
    return rows


# What reviewers typed, by the text's number: a list, all, nothing, or something that cannot be read.
_TYPED = "CASE doc_id % 5 WHEN 0 THEN '2, 4' WHEN 1 THEN ' ALL ' WHEN 2 THEN '' WHEN 3 THEN 'two' ELSE '1 9' END"


@query("P17_typed_selection", UPTO + ", " + LISTS + f""", typed AS (SELECT *, trim(lower({_TYPED})) AS t FROM lists), listed AS (SELECT *, CASE WHEN t = '' THEN [] WHEN t = 'all' THEN range(1, len(stems) + 1) WHEN t = '2, 4' THEN [2, 4] WHEN t = '1 9' THEN [1, 9] END AS places FROM typed)
SELECT doc_id, cluster, array_to_string(list_filter(stems, lambda x, i: list_contains(places, i)), ' ') AS removed, array_to_string(list_filter(stems, lambda x, i: NOT list_contains(places, i)), ' ') AS kept FROM listed WHERE places IS NOT NULL""")
def p17(spark, sf):
    removed, kept = reviews.removed_and_kept(F.col("stems"), F.expr(_TYPED))
    rows = lists_of(spark, sf).select("doc_id", "cluster", removed.alias("removed"), kept.alias("kept")).filter("kept is not null")
    return rows.select("doc_id", "cluster", F.array_join("removed", " ").alias("removed"), F.array_join("kept", " ").alias("kept"))


_EDITS = "CASE (doc_id + CAST(substr(cluster, 9) AS INT)) % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'drop' WHEN 2 THEN 'modify' END"


@query("H02_cluster_review", UPTO + ", " + LISTS + f""", edits AS (SELECT *, {_EDITS} AS action FROM lists),
done AS (SELECT doc_id, CASE WHEN action = 'modify' THEN 'seen_' || cluster ELSE cluster END AS name, CASE WHEN action = 'modify' THEN list_filter(stems, lambda x: x <> stems[1]) ELSE stems END AS stems FROM edits WHERE action IS DISTINCT FROM 'drop')
SELECT doc_id, name, array_to_string(stems, ' ') AS stems FROM done WHERE len(stems) > 0""")
def h02(spark, sf):
    lists = lists_of(spark, sf)
    edits = lists.select("doc_id", "cluster", F.expr(_EDITS).alias("action"), F.concat(F.lit("seen_"), "cluster").alias("new_name"), F.slice("stems", 1, 1).alias("removed")).filter("action is not null")
    return reviews.reviewed_clusters(lists, edits).select("doc_id", "name", F.array_join("stems", " ").alias("stems"))


@query("U02_merged_clusters", UPTO + ", " + LISTS + """, noise AS (SELECT doc_id, cluster, stems[1:2] AS stems FROM lists WHERE cluster <> 'cluster_1'), both_ AS (SELECT doc_id, cluster, stems, 0 AS side FROM lists UNION ALL SELECT doc_id, cluster, stems, 1 FROM noise)
SELECT doc_id, CASE WHEN n > 1 THEN cluster || ' (' || n || ')' ELSE cluster END AS cluster, array_to_string(stems, ' ') AS stems FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY side) AS n FROM both_)""")
def u02(spark, sf):
    lists = lists_of(spark, sf)
    noise = lists.filter("cluster <> 'cluster_1'").withColumn("stems", F.slice("stems", 1, 2))
    return reviews.merged_clusters(lists, noise).select("doc_id", "cluster", F.array_join("stems", " ").alias("stems"))


@query("J10_resplit_clusters", UPTO + """, parts AS (SELECT doc_id, 'part_' || (rank % 4) AS part, stem FROM clusters WHERE cluster <> 'cluster_0' OR rank % 4 = 0),
met AS (SELECT DISTINCT doc_id, cluster, part FROM clusters JOIN parts USING (doc_id, stem)), split AS (SELECT doc_id, cluster FROM met GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, cluster FROM (SELECT DISTINCT doc_id, cluster FROM clusters) ANTI JOIN split USING (doc_id, cluster) UNION ALL SELECT DISTINCT doc_id, part FROM met JOIN split USING (doc_id, cluster)""")
def j10(spark, sf):
    _, top = parts(spark, sf)
    clusters = vocabulary.pseudo_clusters(top)
    pieces = clusters.filter("cluster <> 'cluster_0' or rank % 4 = 0").select("doc_id", F.concat(F.lit("part_"), (F.col("rank") % 4).cast("string")).alias("cluster"), "stem")
    gathered = lambda rows: rows.groupBy("doc_id", "cluster").agg(F.collect_set("stem").alias("stems"))
    return reviews.resplit_clusters(gathered(clusters), gathered(pieces)).select("doc_id", "cluster")


@query("U09_noise_stems", UPTO + " SELECT doc_id, string_agg(DISTINCT stem, ' ' ORDER BY stem) AS stems FROM clusters WHERE rank % 7 = 0 GROUP BY doc_id")
def u09(spark, sf):
    _, top = parts(spark, sf)
    noise = top.withColumn("label", F.when(F.col("rank") % 7 == 0, -1).otherwise(0)).filter("label = -1")
    return noise.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("stem")), " ").alias("stems"))


@query("H06_reclassified", "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'R' ELSE role END AS kind, turn % 3 = 1 AS changed FROM conversations")
def h06(spark, sf):
    spans = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("span_id"), F.col("role").alias("kind"))
    decisions = spans.filter("span_id.turn % 3 = 1").select("span_id", F.lit("R").alias("new_kind"))
    return reviews.reclassified(spans, decisions).select("span_id.conv_id", "span_id.turn", "kind", "changed")


_TRIALS = "trials AS (SELECT conv_id AS group_id, turn AS trial, n_original AS words, 40 AS target, conv_id % 5 <> 0 OR turn > 2 AS sane FROM calls)"


@query("L11_trial_decision", "WITH " + CALLS_SQL + ", " + _TRIALS + """, far AS (SELECT *, abs(words - target) / CAST(target AS DOUBLE) AS far FROM trials), firsts AS (SELECT group_id, min(trial) AS trial FROM far WHERE sane AND far <= 0.05 GROUP BY group_id),
near AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sane DESC, far, trial) AS r FROM far WHERE group_id NOT IN (SELECT group_id FROM firsts))
SELECT group_id, trial, words, 'success' AS outcome FROM far SEMI JOIN firsts USING (group_id, trial) UNION ALL SELECT group_id, trial, words, CASE WHEN NOT sane THEN 'sanity_failed' WHEN far <= 0.15 THEN 'soft_accept' ELSE 'escalate' END FROM near WHERE r = 1""")
def l11(spark, sf):
    rows = calls(spark, sf).select(F.col("conv_id").alias("group_id"), F.col("turn").alias("trial"), F.col("n_original").alias("words"), F.lit(40).alias("target"))
    return reviews.trial_decision(rows.withColumn("sane", (F.col("group_id") % 5 != 0) | (F.col("trial") > 2)))


# Which pairs were picked, by the text's number.
_PICKED = "CASE doc_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '7 99' ELSE 'none of them' END"


@query("H07_chosen_phrases", "WITH " + grams_sql(2, 2) + f""", ranked AS (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, n DESC, first_pos) AS rank FROM gram_counts) WHERE rank <= 20),
named AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN rank = 2 WHEN 1 THEN rank = 7 ELSE false END AS named FROM ranked)
SELECT doc_id, gram, rank FROM (SELECT *, bool_or(named) OVER (PARTITION BY doc_id) AS hits FROM named) WHERE named OR (NOT hits AND rank = 1)""")
def h07(spark, sf):
    ranked = phrases.top_phrases(phrases.gram_counts(phrases.grams(docs_of(spark, sf), range(2, 3))), 20).select("doc_id", "gram", "rank")
    raw = docs_of(spark, sf).select("doc_id", F.expr(_PICKED).alias("picked"))
    return reviews.chosen_pairs(ranked, raw)


@query("F15_marked_word", r"""WITH cut AS (SELECT doc_id, text, strpos(lower(' ' || regexp_replace(text, '[^0-9A-Za-z_]', ' ', 'g') || ' '), ' the ') AS place FROM documents),
sides AS (SELECT doc_id, text, place, substr(text, CAST(place AS BIGINT), 3) AS found, list_filter(string_split_regex(replace(left(text, CAST(place AS BIGINT) - 1), '"', ' '), '\s+'), lambda x: x <> '') AS b, list_filter(string_split_regex(replace(substr(text, CAST(place AS BIGINT) + 3), '"', ' '), '\s+'), lambda x: x <> '') AS a FROM cut)
SELECT doc_id, md5(CASE WHEN place > 0 THEN trim(CASE WHEN len(b) > 6 THEN '... ' ELSE '' END || array_to_string(b[-6:], ' ') || ' "' || found || '" ' || array_to_string(a[1:6], ' ') || CASE WHEN len(a) > 6 THEN ' ...' ELSE '' END) ELSE text END) AS digest FROM sides""")
def f15(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(reviews.marked_word(F.col("text"), F.lit("the"), 6)).alias("digest"))


@query("F35_words_a_side", f"SELECT doc_id, greatest(1, CAST(floor(greatest(128 - 5 - len({W.word_array_sql('text')}), 2) / CAST(1.6 AS DOUBLE) / 2) AS INT)) AS words FROM documents")
def f35(spark, sf):
    return docs_of(spark, sf).select("doc_id", reviews.words_a_side(F.size(W.word_array(F.col("text")))).alias("words"))


@query("F13_plain_stems", UPTO + " SELECT DISTINCT doc_id, stem AS plain FROM clusters")
def f13(spark, sf):
    _, top = parts(spark, sf)
    return top.select("doc_id", reviews.plain_stem(F.concat(F.upper("stem"), F.lit("**"))).alias("plain")).distinct()


@query("F16_highlighted", W.with_sql("sentences") + r""", w AS (SELECT doc_id, sent_id, list_filter(string_split_regex(sentence, '\s+'), lambda x: x <> '') AS w FROM sentences)
SELECT doc_id, sent_id, md5(array_to_string(list_transform(w, lambda x: CASE WHEN length(x) >= 8 THEN '****' || x || '****' ELSE x END), ' ')) AS digest FROM w""")
def f16(spark, sf):
    rows = W.sentences(docs_of(spark, sf)).withColumn("w", F.filter(F.split("sentence", r"\s+"), lambda x: x != ""))
    return rows.select("doc_id", "sent_id", F.md5(reviews.highlighted(F.col("w"), F.transform("w", lambda x: F.length(x) >= 8))).alias("digest"))


@query("W17_fitted_contexts")
def w17(spark, sf):
    rows = W.sentences(docs_of(spark, sf)).filter("sent_id < 6").withColumn("n", F.size(W.word_array(F.col("sentence"))))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "n")))["n"].alias("lengths"))
    return lists.select("doc_id", F.array_join(F.transform(reviews.fitted_contexts(F.col("lengths"), 60), lambda x: x.cast("string")), ",").alias("given"))


@query("A11_instances_of_stems", UPTO + ", " + OCCURRENCES + " SELECT doc_id, stem, count(*) AS n, md5(string_agg(pos, ',' ORDER BY pos)) AS places FROM occ GROUP BY ALL")
def a11(spark, sf):
    places, _, _, _ = places_of(spark, sf)
    gathered = places.groupBy("doc_id", F.col("term").alias("stem")).agg(F.array_sort(F.collect_list("pos")).alias("p"))
    return gathered.select("doc_id", "stem", F.size("p").cast("long").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: x.cast("string")), ",")).alias("places"))


@query("A12_first_distinct_words", UPTO + ", stem_words AS (SELECT doc_id, stem, lower, min(pos) AS first_pos FROM stemmed JOIN top USING (doc_id, stem) WHERE regexp_matches(lower, '^[a-z]+$') GROUP BY ALL) SELECT doc_id, stem, string_agg(lower, ' ' ORDER BY first_pos) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stem ORDER BY first_pos) AS r FROM stem_words) WHERE r <= 5 GROUP BY doc_id, stem")
def a12(spark, sf):
    rows, top = parts(spark, sf)
    found = rows.filter(F.col("lower").rlike("^[a-z]+$")).join(top.select("doc_id", "stem"), ["doc_id", "stem"])
    firsts = found.groupBy("doc_id", "stem", "lower").agg(F.min("pos").alias("first_pos"))
    firsts = firsts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "stem").orderBy("first_pos"))).filter("r <= 5")
    return firsts.groupBy("doc_id", "stem").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "lower")))["lower"], " ").alias("words"))


@query("A28_totals", UPTO + " SELECT doc_id, count(DISTINCT cluster) AS n_clusters, count(*) AS n_stems FROM clusters GROUP BY doc_id")
def a28(spark, sf):
    return lists_of(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_clusters"), F.sum(F.size("stems")).alias("n_stems"))


@query("J15_prefix_matches", UPTO + ", words AS (SELECT DISTINCT doc_id, lower FROM tokens WHERE regexp_matches(lower, '^[a-z]+$')) SELECT doc_id, lower AS word, count(*) AS n FROM words JOIN (SELECT doc_id, stem FROM top WHERE rank <= 5) t USING (doc_id) WHERE starts_with(lower, stem) OR starts_with(stem, lower) GROUP BY ALL")
def j15(spark, sf):
    _, top = parts(spark, sf)
    stems = top.filter("rank <= 5").groupBy("doc_id").agg(F.collect_list("stem").alias("stems"))
    words = W.tokens(docs_of(spark, sf)).filter(F.col("lower").rlike("^[a-z]+$")).select("doc_id", F.col("lower").alias("word")).distinct()
    hits = F.filter("stems", lambda s: F.startswith(F.col("word"), s) | F.startswith(s, F.col("word")))
    return words.join(stems, "doc_id").select("doc_id", "word", F.size(hits).cast("long").alias("n")).filter("n > 0")


@query("J20_clusters_of_tokens", UPTO + ", " + OCCURRENCES + ", twice AS (SELECT doc_id, stem, cluster FROM clusters UNION ALL SELECT doc_id, stem, 'other' FROM clusters WHERE rank % 4 = 0) SELECT doc_id, pos, string_agg(cluster, ',' ORDER BY cluster) AS clusters FROM occ JOIN twice USING (doc_id, stem) GROUP BY doc_id, pos")
def j20(spark, sf):
    places, clusters, _, _ = places_of(spark, sf)
    twice = clusters.select("doc_id", F.col("stem").alias("term"), "cluster").unionByName(clusters.filter("rank % 4 = 0").select("doc_id", F.col("stem").alias("term"), F.lit("other").alias("cluster")))
    lists = twice.groupBy("doc_id", "term").agg(F.array_join(F.array_sort(F.collect_list("cluster")), ",").alias("clusters"))
    return places.join(lists, ["doc_id", "term"]).select("doc_id", "pos", "clusters")


@query("J32_sentence_union", W.with_sql("sentences", DENSITY) + " SELECT doc_id, sent_id, CASE WHEN sent_id % 2 = 0 THEN 'second' ELSE 'first' END AS cluster FROM dens WHERE sent_id % 2 = 0 OR density >= 0.5")
def j32(spark, sf):
    rows = selection.densities(docs_of(spark, sf)).select("doc_id", "sent_id", "density")
    both = rows.filter("density >= 0.5").withColumn("cluster", F.lit("first")).unionByName(rows.filter("sent_id % 2 = 0").withColumn("cluster", F.lit("second")))
    return both.groupBy("doc_id", "sent_id").agg(F.max("cluster").alias("cluster"))  # the last cluster wins


@query("O06_top_collocates", UPTO + ", " + OCCURRENCES + """, hits AS (SELECT o.doc_id, o.pos FROM occ o JOIN top t USING (doc_id, stem) WHERE t.rank = 1), near AS (SELECT h.doc_id, h.pos, unnest(range(h.pos - 5, h.pos + 6)) AS p FROM hits h),
counted AS (SELECT t.doc_id, t.lower AS word, count(*) AS cnt FROM tokens t JOIN near n ON n.doc_id = t.doc_id AND n.p = t.pos AND n.pos <> t.pos WHERE regexp_matches(t.lower, '^[a-z]+$') AND t.lower NOT IN (""" + W.sql_list(W.FUNCTION_WORDS) + """) GROUP BY ALL)
SELECT doc_id, word, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, word) AS rank FROM counted) WHERE rank <= 20""")
def o06(spark, sf):
    rows, top = parts(spark, sf)
    anchors = reading.positions(rows.filter(F.col("lower").rlike("^[a-z]+$")), top.filter("rank = 1"))
    near = reading.collocates(W.tokens(docs_of(spark, sf)).filter(vocabulary.is_content()), anchors, 5)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "word")).cast("long")).filter("rank <= 20")


@query("O08_top_terms", UPTO + " SELECT doc_id, stem, cnt, rank FROM top WHERE rank <= 25")
def o08(spark, sf):
    return parts(spark, sf)[1].filter("rank <= 25").select("doc_id", "stem", "cnt", "rank")


@query("O10_retrieved_chunks", """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), scored AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS d FROM embeddings, q)
SELECT vec_id FROM (SELECT *, row_number() OVER (ORDER BY d DESC, vec_id) AS r FROM scored) WHERE r <= 5 OR vec_id < 3""")
def o10(spark, sf):
    from lectern.operators.verification import dot

    rows = table(spark, sf, "embeddings")
    first = rows.orderBy("vec_id").select(F.col("embedding").alias("e")).limit(1)  # one row
    scored = rows.join(F.broadcast(first)).select("vec_id", dot(F.transform("embedding", lambda x: x.cast("double")), F.transform("e", lambda x: x.cast("double"))).alias("d"))
    return scored.orderBy(F.desc("d"), "vec_id").limit(5).select("vec_id").unionByName(rows.filter("vec_id < 3").select("vec_id")).distinct()


@query("P20_contributing_turns", "SELECT conv_id, string_agg(turn, ',' ORDER BY share DESC, turn) AS turns FROM (SELECT conv_id, turn, length(text) / CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS DOUBLE) AS share FROM conversations) WHERE share >= 0.15 GROUP BY conv_id")
def p20(spark, sf):
    share = F.length("text") / F.sum(F.length("text")).over(Window.partitionBy("conv_id"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", share.alias("share")).filter("share >= 0.15")
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "turn"))).alias("t"))
    return lists.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"].cast("string")), ",").alias("turns"))


@query("P21_skip_reason", "SELECT conv_id, CASE WHEN n < 2 THEN 'one_turn' WHEN n_users = 0 THEN 'no_user' WHEN n_assistants = 0 THEN 'no_answer' END AS reason FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_users, count(*) FILTER (WHERE role = 'assistant') AS n_assistants FROM conversations GROUP BY conv_id)")
def p21(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return rows.select("conv_id", F.when(F.col("n") < 2, "one_turn").when(F.col("u") == 0, "no_user").when(F.col("a") == 0, "no_answer").alias("reason"))


@query("P27_oversize_words", f"SELECT DISTINCT doc_id, w AS word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{W.TOKEN.replace(chr(39), chr(39) * 2)}')) AS w FROM documents) WHERE length(w) > 10")
def p27(spark, sf):
    return W.tokens(docs_of(spark, sf)).filter(F.length("token") > 10).select("doc_id", F.col("token").alias("word")).distinct()


@query("P28_name_check", r"SELECT DISTINCT source, regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9_-]*') AS valid FROM documents")
def p28(spark, sf):
    return table(spark, sf, "documents").select("source", F.col("source").rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$").alias("valid")).distinct()


@query("S09_resumable_phases", "SELECT source AS corpus, bool_or(lang = 'en') AS first, bool_or(lang = 'en') AND bool_or(lang = 'de') AS second FROM documents GROUP BY source")
def s09(spark, sf):
    files = table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.col("lang").alias("file"))
    return reviews.resumable(files, {"first": ["en"], "second": ["en", "de"]})


@query("A41_longest_text_a_source", "SELECT source, max(length(text)) AS longest FROM documents GROUP BY source")
def a41(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.max(F.length("text")).cast("long").alias("longest"))


@query("U10_missing", "SELECT DISTINCT lang FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE n_chars > 20000)")
def u10(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "n_chars").filter("lang is not null")
    return rows.select("lang").distinct().join(rows.filter("n_chars > 20000").select("lang").distinct(), "lang", "left_anti")


@query("S05_joined_pages", r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM documents")
def s05(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(files.joined_pages(F.split("text", "[.] "))).alias("digest"))


@query("S18_csv_round_trip", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def s18(spark, sf):
    path = files.shared_folder(spark, "csv")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    back = spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("H09_config_log", "SELECT * FROM (VALUES ('c', 'phase1', 'setup', 'cap', '150'), ('c', 'phase1', 'setup', 'percentile', '0.9')) v(corpus, phase, step, decision_type, choice)")
def h09(spark, sf):
    return files.config_rows(spark, "c", "phase1", {"percentile": 0.9, "cap": 150})


@query("S21_environment")
def s21(spark, sf):
    return files.environment(spark)


@query("F41_report_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS at FROM events")
def f41(spark, sf):
    return table(spark, sf, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("at"))


@query("F42_deadlines", "SELECT event_id, epoch(ts) - epoch(lag(ts) OVER w) > 3600 AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def f42(spark, sf):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))
    return table(spark, sf, "events").select("event_id", (seconds("ts") - seconds(before) > 3_600_000_000).alias("late"))


@query("F26_trial_lines", "WITH " + CALLS_SQL + " SELECT conv_id, turn, 'trial ' || lpad(CAST(turn AS VARCHAR), 3, ' ') || ': ' || lpad(CAST(n_original AS VARCHAR), 6, ' ') || ' words' AS line FROM calls")
def f26(spark, sf):
    return calls(spark, sf).select("conv_id", "turn", F.format_string("trial %3d: %6d words", F.col("turn").cast("int"), F.col("n_original").cast("int")).alias("line"))


@query("F36_chart_heights", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, CAST(round(100.0 * n / max(n) OVER (PARTITION BY lang)) AS BIGINT) AS height FROM c")
def f36(spark, sf):
    rows = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return rows.select("lang", "source", F.round(100.0 * F.col("n") / F.max("n").over(Window.partitionBy("lang"))).cast("long").alias("height"))


@query("P16_body_blocks", W.with_sql("lines") + r""", kinds AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*Definition\s+\d+') THEN 'defn' WHEN regexp_matches(line, '^\s*\d+\.\d+\s+\S') THEN 'h3' WHEN regexp_matches(line, '^\s*\d+\.?\s+[A-Z]') THEN 'h2' ELSE 'p' END AS kind FROM lines),
marked AS (SELECT *, CASE WHEN kind = 'p' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = 'p' THEN 0 ELSE 1 END AS new FROM kinds) SELECT doc_id, kind, CAST(sum(new) AS BIGINT) AS blocks FROM marked WHERE kind IN ('p', 'defn') GROUP BY ALL""")
def p16(spark, sf):
    from lectern.operators.verification import blocks

    return blocks(W.lines(docs_of(spark, sf))).filter(F.col("kind").isin("p", "defn")).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"))


@query("P23_stems_without_senses", UPTO + ", ranked AS (SELECT word, left(word, 2) AS letters, row_number() OVER (PARTITION BY left(word, 2) ORDER BY word) AS rank FROM (SELECT DISTINCT lower AS word FROM tokens WHERE regexp_matches(lower, '^[a-z]{4,}$'))), known AS (SELECT a.word FROM ranked a SEMI JOIN ranked b ON b.letters = a.letters AND b.rank = a.rank + 1), eligible AS (SELECT DISTINCT doc_id, stem FROM stemmed WHERE lower IN (SELECT word FROM known)) SELECT doc_id, stem FROM top ANTI JOIN eligible USING (doc_id, stem)")
def p23(spark, sf):
    from lectern.operators import senses
    from lectern.plans.models import ranked_words

    rows, top = parts(spark, sf)
    known = senses.inventory(ranked_words(spark, sf), "letters").select(F.col("word").alias("lower")).distinct()
    eligible = rows.select("doc_id", "stem", "lower").distinct().join(known, "lower", "left_semi").select("doc_id", "stem")
    return top.select("doc_id", "stem").join(eligible, ["doc_id", "stem"], "left_anti")


@query("M04_hashed_vectors", W.with_sql("tokens") + f", c AS (SELECT doc_id, left(md5(lower), 1) AS bucket, count(*) AS n FROM tokens WHERE regexp_matches(lower, '^[a-z]+$') AND lower NOT IN ({W.sql_list(W.FUNCTION_WORDS)}) GROUP BY ALL) SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c")
def m04(spark, sf):
    content = W.tokens(docs_of(spark, sf)).filter(vocabulary.is_content())
    counts = content.groupBy("doc_id", F.substring(F.md5("lower"), 1, 1).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


@query("H03_sweep_choice", UPTO + """, tried AS (SELECT doc_id, share, count(*) AS n_stems FROM (SELECT doc_id, stem, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM stem_counts), (SELECT unnest([CAST(0.8 AS DOUBLE), 0.9]) AS share) s WHERE r <= ceil(n * (1 - share)) GROUP BY ALL)
SELECT doc_id, share, n_stems FROM tried WHERE share = CASE WHEN doc_id % 3 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END""")
def h03(spark, sf):
    rows, _ = parts(spark, sf)
    swept = vocabulary.sweep(rows, [0.8, 0.9])
    choices = docs_of(spark, sf).filter("doc_id % 3 = 0").select("doc_id", F.lit(0.8).alias("chosen"))
    return swept.join(choices, "doc_id", "left").filter(F.col("share") == F.coalesce("chosen", F.lit(0.9))).select("doc_id", "share", "n_stems")


@query("L06_recovered_noise")
def l06(spark, sf):
    from lectern.operators import clustering

    places, _, top, rows = places_of(spark, sf)
    noise = top.filter("rank % 7 = 0").select("doc_id", F.col("stem").alias("term"))
    total = rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    points = places.join(noise, ["doc_id", "term"]).join(total, "doc_id")
    points = points.select("doc_id", "term", F.col("pos").cast("long").alias("item"), F.array(F.lit(1.0), F.col("pos") / F.col("n_tokens")).alias("vector"))
    return clustering.recovered_noise(points).select("doc_id", "label", F.array_join("stems", " ").alias("stems"))


@query("A15_cluster_hits", UPTO + ", " + OCCURRENCES + ", " + W.SQL["sentences"] + ", " + DENSITY + ", " + PHRASES + """, s AS (SELECT doc_id, cluster, count(*) AS n FROM occ JOIN clusters USING (doc_id, stem) GROUP BY ALL),
p AS (SELECT doc_id, cluster, sum((length(lower(text)) - length(replace(lower(text), gram, ''))) // length(gram)) AS n FROM phrases JOIN documents USING (doc_id) GROUP BY ALL)
SELECT doc_id, cluster, CAST(coalesce(s.n, 0) AS BIGINT) AS stem_hits, CAST(coalesce(p.n, 0) AS BIGINT) AS phrase_hits FROM s FULL JOIN p USING (doc_id, cluster)""")
def a15(spark, sf):
    texts, clusters = texts_and_clusters(spark, sf)
    stems = clusters.filter("doc_id is not null").groupBy("doc_id", "cluster").agg(F.sum("hits").alias("stem_hits"))
    grams = selection.cluster_phrases(selection.sentence_grams(texts), clusters).select("doc_id", "cluster", "gram")
    texts = texts.select("doc_id", F.lower("text").alias("text"))
    n = F.floor((F.length("text") - F.length(F.replace(F.col("text"), F.col("gram"), F.lit("")))) / F.length("gram"))
    found = grams.join(texts, "doc_id").groupBy("doc_id", "cluster").agg(F.sum(n).alias("phrase_hits"))
    return stems.join(found, ["doc_id", "cluster"], "full").select("doc_id", "cluster", F.coalesce("stem_hits", F.lit(0)).cast("long").alias("stem_hits"), F.coalesce("phrase_hits", F.lit(0)).cast("long").alias("phrase_hits"))


@query("J07_tokens_by_sentence", W.with_sql("sentences") + ", d AS (SELECT DISTINCT sentence FROM sentences) SELECT md5(sentence) AS digest, len(regexp_extract_all(sentence, '[A-Za-z'']+')) AS n_tokens FROM d")
def j07(spark, sf):
    distinct = W.sentences(docs_of(spark, sf)).select("sentence").distinct()
    return distinct.select(F.md5("sentence").alias("digest"), F.size(F.regexp_extract_all("sentence", F.lit("([A-Za-z']+)"), F.lit(1))).cast("long").alias("n_tokens"))


@query("J22_cited_sentences", W.with_sql("sentences") + ", cited AS (SELECT DISTINCT doc_id, unnest([0, 2, 5, 100000]) AS ref FROM documents) SELECT doc_id, CAST(ref AS INT) AS ref, md5(sentence) AS digest FROM cited JOIN sentences s USING (doc_id) WHERE s.sent_id = ref")
def j22(spark, sf):
    rows = docs_of(spark, sf).select("doc_id", W.sentence_array(F.col("text")).alias("s"), F.explode(F.array(*(F.lit(i) for i in (0, 2, 5, 100_000)))).alias("ref"))
    return rows.filter(F.col("ref") < F.size("s")).select("doc_id", "ref", F.md5(F.get("s", F.col("ref"))).alias("digest"))


@query("J24_decisions_by_word", "WITH flagged AS (SELECT event_id, event_type AS word FROM events), kinds AS (SELECT DISTINCT event_type AS word, upper(event_type) AS typed FROM events) SELECT event_id, CASE WHEN ascii(lower(word)) % 2 = 0 THEN 'keep' ELSE 'open' END AS choice FROM flagged")
def j24(spark, sf):
    flagged = table(spark, sf, "events").select("event_id", F.col("event_type").alias("word"))
    typed = flagged.select(F.upper("word").alias("typed")).distinct().filter(F.ascii(F.lower("typed")) % 2 == 0).select(F.lower("typed").alias("low"), F.lit("keep").alias("choice"))
    return flagged.join(typed, F.lower("word") == F.col("low"), "left").select("event_id", F.coalesce("choice", F.lit("open")).alias("choice"))


@query("L07_inserted_words")
def l07(spark, sf):
    from lectern.operators.sequences import inserted_places

    rows = calls(spark, sf).filter("n_fixed > 0").withColumn("w", W.word_array(F.col("fixed")))
    places = inserted_places(W.word_array(F.col("original")), F.col("w"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(places, lambda i: F.get("w", i)), " ").alias("inserted"))


@query("L09_span_ids", W.with_sql("sentences") + " SELECT doc_id, sent_id, 's' || row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS span_id FROM sentences QUALIFY length(sentence) >= 40")
def l09(spark, sf):
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id"))
    return W.sentences(docs_of(spark, sf)).withColumn("span_id", F.concat(F.lit("s"), n.cast("string"))).filter(F.length("sentence") >= 40).select("doc_id", "sent_id", "span_id")


@query("M01_annotated_tokens", W.with_sql("sentences") + f""", t AS (SELECT doc_id, lower(unnest(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}'']+'))) AS w FROM sentences)
SELECT doc_id, CASE WHEN w IN ('and', 'but', 'or', 'nor', 'yet', 'because', 'although', 'though', 'since', 'while', 'whereas', 'if', 'that', 'unless', 'until') THEN 'SCONJ'
 WHEN w IN ('however', 'furthermore', 'therefore', 'thus', 'moreover', 'hence', 'nevertheless', 'consequently', 'indeed', 'then', 'also') THEN 'ADV' WHEN w IN ({W.sql_list(W.FUNCTION_WORDS)}) THEN 'ADP' ELSE 'NOUN' END AS pos, count(*) AS n FROM t GROUP BY ALL""")
def m01(spark, sf):
    from lectern.operators.sequences import tagged_by_lists

    tokens = W.sentences(docs_of(spark, sf)).select("doc_id", F.explode(tagged_by_lists(F.col("sentence"))).alias("t"))
    return tokens.groupBy("doc_id", "t.pos").agg(F.count("*").alias("n"))


@query("M06_retrieved_metadata", f"""WITH w AS (SELECT doc_id, {W.word_array_sql('text')} AS w FROM documents), c AS (SELECT doc_id, start // 120 AS chunk, w[start + 1:start + 120] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), 120)) AS start FROM w)),
s AS (SELECT doc_id, chunk, len(list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ('by', 'author', 'title', 'date', 'published'))) AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) AS r FROM s)
SELECT doc_id, string_agg(chunk, ',' ORDER BY chunk) AS chunks FROM r WHERE r <= 5 OR chunk < 3 GROUP BY doc_id""")
def m06(spark, sf):
    one_line = docs_of(spark, sf).select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    chunks = one_line.select("doc_id", F.posexplode(W.paragraph_chunks(F.col("text"), 120)).alias("chunk", "text"))
    asked = ("by", "author", "title", "date", "published")
    scored = chunks.select("doc_id", "chunk", F.size(F.filter(F.split(F.lower("text"), " "), lambda x: x.isin(*asked))).alias("score"))
    return reviews.retrieved(scored, 5, 3).select("doc_id", F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"))


@query("O05_top_collocations", UPTO + ", " + OCCURRENCES + ", " + POOL + """, pl AS (SELECT o.doc_id, o.stem AS term, o.pos FROM occ o JOIN pool p ON p.doc_id = o.doc_id AND p.term = o.stem),
pairs AS (SELECT a.doc_id, a.term AS term_a, b.term AS term_b FROM pool a JOIN pool b ON a.doc_id = b.doc_id AND a.cluster < b.cluster),
near AS (SELECT x.doc_id, x.term AS term_a, y.term AS term_b, count(DISTINCT x.pos) AS hits FROM (SELECT *, unnest(range(pos - 10, pos + 11)) AS q FROM pl) x JOIN pl y ON y.doc_id = x.doc_id AND y.pos = x.q AND y.pos <> x.pos GROUP BY ALL)
SELECT doc_id, term_a, term_b, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, term_a, term_b) AS rank FROM pairs JOIN near USING (doc_id, term_a, term_b)) WHERE rank <= 20""")
def o05(spark, sf):
    found = collocations_of(spark, sf)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "term_a", "term_b")).cast("long")
    return found.withColumn("rank", rank).filter("rank <= 20").select("doc_id", "term_a", "term_b", "hits", "rank")


@query("O14_shown_items", UPTO + ", " + LISTS + " SELECT doc_id, cluster, array_to_string(stems[1:5], ', ') || CASE WHEN len(stems) > 5 THEN ' and ' || (len(stems) - 5) || ' more' ELSE '' END AS shown FROM lists")
def o14(spark, sf):
    return lists_of(spark, sf).select("doc_id", "cluster", reviews.shown(F.col("stems"), 5).alias("shown"))


@query("U03_reembedded_stems", UPTO + ", direct AS (SELECT doc_id, stem FROM clusters WHERE rank % 3 = 0 UNION SELECT doc_id, stem FROM clusters WHERE rank % 5 = 0) SELECT doc_id, cluster, string_agg(stem, ' ' ORDER BY stem) AS stems FROM clusters SEMI JOIN direct USING (doc_id, stem) GROUP BY ALL")
def u03(spark, sf):
    _, top = parts(spark, sf)
    clusters = vocabulary.pseudo_clusters(top)
    sets = clusters.groupBy("doc_id").agg(F.collect_set(F.when(F.col("rank") % 3 == 0, F.col("stem"))).alias("direct"), F.collect_set(F.when(F.col("rank") % 5 == 0, F.col("stem"))).alias("resplit"))
    lists = clusters.groupBy("doc_id", "cluster").agg(F.collect_set("stem").alias("stems")).join(sets, "doc_id")
    both = F.array_sort(F.array_intersect("stems", F.array_union("direct", "resplit")))
    return lists.select("doc_id", "cluster", F.array_join(both, " ").alias("stems")).filter("stems <> ''")


@query("H05_escalations", "WITH " + CALLS_SQL + " SELECT conv_id, turn, n_original > 100 AND NOT failed AND conv_id % 2 = 0 AS escalated FROM calls")
def h05(spark, sf):
    rows = calls(spark, sf)
    asked = rows.filter("conv_id % 2 = 0").select("conv_id", F.lit(True).alias("agreed")).distinct()
    return rows.join(asked, "conv_id", "left").select("conv_id", "turn", ((F.col("n_original") > 100) & ~F.col("failed") & F.coalesce("agreed", F.lit(False))).alias("escalated"))


@query("H04_chosen_candidates", "WITH " + CALLS_SQL + " SELECT conv_id, turn, n_original AS words FROM calls WHERE turn = conv_id % 3 OR (conv_id % 3 = 2 AND turn = 0)")
def h04(spark, sf):
    rows = calls(spark, sf).select("conv_id", "turn", F.col("n_original").alias("words"))
    picked = rows.filter("turn = conv_id % 3 or (conv_id % 3 = 2 and turn = 0)").select("conv_id", "turn").distinct()
    return rows.join(picked, ["conv_id", "turn"], "left_semi")
