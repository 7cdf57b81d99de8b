"""Queries of outcome audits, trials, review answers and event logs, over conversations, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import audit, sequences
from lectern.plans.registry import query
from lectern.session import table

#: Calls of an audit made from conversations: an assistant's turn is a reviewed text, cut or kept by its number.
CALLS_SQL = rf"""calls AS (SELECT conv_id, turn, 'c' || (conv_id % 3) AS condition, 'tag' || (conv_id % 4) AS tag, text AS original,
  CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN '' WHEN 1 THEN 'VERDICT: OK' WHEN 2 THEN 'nothing to say' WHEN 3 THEN 'VERDICT: FIXED' || chr(10) || 'ISSUES: a, b' || chr(10) || 'TEXT: ' || text
   WHEN 4 THEN 'VERDICT: FIXED' || chr(10) || 'ISSUES: none' || chr(10) || 'TEXT: ' || text || ' more' ELSE 'verdict: fixed' || chr(10) || 'TEXT: short' END AS response,
  (conv_id + turn) % 11 = 0 AS failed, len({W.word_array_sql('text')}) AS n_original FROM conversations),
parsed AS (SELECT *, upper(trim(regexp_extract(response, '(?i)VERDICT:\s*(\w+)', 1))) AS verdict, trim(regexp_extract(response, '(?i)ISSUES:[ \t]*([^\n]*)', 1)) AS issues, trim(regexp_extract(response, '(?is)TEXT:\s*(.*)$', 1)) AS fixed FROM calls),
sized AS (SELECT *, len({W.word_array_sql('fixed')}) AS n_fixed, n_original AS target FROM parsed),
outcomes AS (SELECT *, CASE WHEN failed THEN 'call_failed' WHEN trim(response) = '' THEN 'empty_response' WHEN verdict = 'OK' THEN 'ok' WHEN verdict <> 'FIXED' THEN 'unparseable' WHEN n_fixed = 0 THEN 'fixed_no_text'
  WHEN n_fixed < 0.5 * target THEN 'fixed_rejected_short' WHEN trim(regexp_replace(fixed, '\s+', ' ', 'g')) = trim(regexp_replace(original, '\s+', ' ', 'g')) THEN 'fixed_identical' WHEN n_fixed > 1.05 * greatest(n_original, target) THEN 'fixed_expanded' ELSE 'fixed_changed' END AS category FROM sized)"""
DOMAIN = sorted(audit.GROUPS)


def calls(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id") % 3).alias("condition"), F.concat(F.lit("tag"), F.col("conv_id") % 4).alias("tag"), F.col("text").alias("original"))
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 6
    answer = F.when(kind == 0, "").when(kind == 1, "VERDICT: OK").when(kind == 2, "nothing to say").when(kind == 3, F.concat(F.lit("VERDICT: FIXED\nISSUES: a, b\nTEXT: "), "original")).when(kind == 4, F.concat(F.lit("VERDICT: FIXED\nISSUES: none\nTEXT: "), "original", F.lit(" more"))).otherwise("verdict: fixed\nTEXT: short")
    rows = rows.withColumn("response", answer).withColumn("failed", (F.col("conv_id") + F.col("turn")) % 11 == 0).withColumn("n_original", W.word_count(F.col("original")))
    got = audit.parsed(F.col("response"))
    rows = rows.withColumns({"verdict": got["verdict"], "issues": got["issues"], "fixed": got["text"]})
    return rows.withColumn("n_fixed", W.word_count(F.col("fixed"))).withColumn("target", F.col("n_original"))


def outcomes(spark, sf):
    return audit.outcome(calls(spark, sf))


@query("F19_parse_review", "WITH " + CALLS_SQL + " SELECT conv_id, turn, verdict, issues, md5(fixed) AS digest FROM sized")
def f19(spark, sf):
    return calls(spark, sf).select("conv_id", "turn", "verdict", "issues", F.md5("fixed").alias("digest"))


@query("L13_outcome_taxonomy", "WITH " + CALLS_SQL + " SELECT conv_id, turn, category FROM outcomes")
def l13(spark, sf):
    return outcomes(spark, sf).select("conv_id", "turn", "category")


@query("L12_review_acceptance", "WITH " + CALLS_SQL + " SELECT conv_id, turn, verdict = 'FIXED' AND fixed <> '' AND n_fixed >= 0.5 * target AS accepted FROM sized")
def l12(spark, sf):
    return calls(spark, sf).select("conv_id", "turn", ((F.col("verdict") == "FIXED") & (F.col("fixed") != "") & (F.col("n_fixed") >= 0.5 * F.col("target"))).alias("accepted"))


_DOMAIN = ", ".join(f"'{d}'" for d in DOMAIN)
_WILSON = f"""greatest(0.0, (p + {audit.Z} * {audit.Z} / (2 * n)) / (1 + {audit.Z} * {audit.Z} / n) - {audit.Z} * sqrt(p * (1 - p) / n + {audit.Z} * {audit.Z} / (4 * n * n)) / (1 + {audit.Z} * {audit.Z} / n)) AS low,
 least(1.0, (p + {audit.Z} * {audit.Z} / (2 * n)) / (1 + {audit.Z} * {audit.Z} / n) + {audit.Z} * sqrt(p * (1 - p) / n + {audit.Z} * {audit.Z} / (4 * n * n)) / (1 + {audit.Z} * {audit.Z} / n)) AS high"""


@query("A30_wilson_interval", "WITH " + CALLS_SQL + f", cells AS (SELECT condition, category, count(*) AS k FROM outcomes GROUP BY ALL), totals AS (SELECT condition, count(*) AS n FROM outcomes GROUP BY condition), full_ AS (SELECT t.condition, d.category, coalesce(k, 0) AS k, n, coalesce(k, 0) / CAST(n AS DOUBLE) AS p FROM totals t, (SELECT unnest([{_DOMAIN}]) AS category) d LEFT JOIN cells c ON c.condition = t.condition AND c.category = d.category) SELECT condition, category, k, n, round(p, 9) AS share, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT *, {_WILSON} FROM full_)")
def a30(spark, sf):
    found = audit.shares(outcomes(spark, sf), ["condition"], "category", DOMAIN)
    return found.select("condition", "category", "k", "n", *(F.round(c, 9).alias(c) for c in ("share", "low", "high")))


@query("A31_ratio_thresholds", "WITH " + CALLS_SQL + " SELECT condition, t AS threshold, count(*) FILTER (WHERE n_fixed / CAST(n_original AS DOUBLE) >= t) AS k, count(*) AS n FROM outcomes, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(1.0 AS DOUBLE)]) AS t) WHERE n_fixed > 0 AND n_original > 0 GROUP BY ALL")
def a31(spark, sf):
    ratio = F.col("n_fixed") / F.col("n_original")
    rows = outcomes(spark, sf).filter("n_fixed > 0 and n_original > 0").withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (0.5, 0.9, 1.0)))))
    return rows.groupBy("condition", "threshold").agg(F.count_if(ratio >= F.col("threshold")).alias("k"), F.count("*").alias("n"))


@query("A32_length_quantiles", "WITH " + CALLS_SQL + " SELECT condition, count(*) AS n, min(r) AS low, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS p75, quantile_cont(r, 0.95) AS p95, max(r) AS high, avg(CASE WHEN r > 1.05 THEN 1.0 ELSE 0.0 END) AS above FROM (SELECT condition, n_fixed / CAST(n_original AS DOUBLE) AS r FROM outcomes WHERE n_fixed > 0 AND n_original > 0) GROUP BY condition")
def a32(spark, sf):
    rows = outcomes(spark, sf).filter("n_fixed > 0 and n_original > 0").withColumn("r", F.col("n_fixed") / F.col("n_original"))
    each = [F.percentile("r", p).alias(name) for name, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))]
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.min("r").alias("low"), *each, F.max("r").alias("high"), F.avg(F.when(F.col("r") > 1.05, 1.0).otherwise(0.0)).alias("above"))


_GROUP = "CASE category " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in audit.GROUPS.items()) + " END"


@query("A33_groups_by_tag", "WITH " + CALLS_SQL + f" SELECT condition, tag, {', '.join(f'count(*) FILTER (WHERE {_GROUP} = {chr(39)}{g}{chr(39)}) AS {g}' for g in sorted(set(audit.GROUPS.values())))} FROM outcomes GROUP BY condition, tag")
def a33(spark, sf):
    groups = sorted(set(audit.GROUPS.values()))
    return outcomes(spark, sf).groupBy("condition", "tag").pivot("group", groups).agg(F.count(F.lit(1))).fillna(0, groups)


@query("A35_median_words", "WITH " + CALLS_SQL + " SELECT condition, median(n_original) AS median_words, max(n_original) AS most FROM calls GROUP BY condition")
def a35(spark, sf):
    return calls(spark, sf).groupBy("condition").agg(F.median("n_original").alias("median_words"), F.max("n_original").alias("most"))


@query("A36_homogeneity", """WITH t AS (SELECT d.source, l.quality FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT source, count(*) AS r FROM t GROUP BY source), c AS (SELECT quality, count(*) AS c FROM t GROUP BY quality), o AS (SELECT source, quality, count(*) AS o FROM t GROUP BY ALL),
e AS (SELECT r.source, c.quality, r.r * c.c / (SELECT CAST(count(*) AS DOUBLE) FROM t) AS e, coalesce(o.o, 0) AS o FROM r, c LEFT JOIN o ON o.source = r.source AND o.quality = c.quality) SELECT round(sum((o - e) * (o - e) / e), 9) AS chi2, (count(DISTINCT source) - 1) * (count(DISTINCT quality) - 1) AS df FROM e""")
def a36(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return audit.chi_square(rows, "source", "quality").select(F.round("chi2", 9).alias("chi2"), "df")


@query("A38_rollup_with_total", "WITH " + CALLS_SQL + " SELECT condition, tag, CAST(sum(n_original) AS BIGINT) AS words, count(*) AS calls FROM calls GROUP BY ROLLUP (condition, tag)")
def a38(spark, sf):
    return calls(spark, sf).rollup("condition", "tag").agg(F.sum("n_original").alias("words"), F.count("*").alias("calls"))


@query("A39_latest_choice", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS choice, count(*) AS n FROM events GROUP BY ALL")
def a39(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("choice"), F.count("*").alias("n"))


@query("W18_best_trial", "WITH " + CALLS_SQL + " SELECT group_id, trial, words FROM (SELECT conv_id AS group_id, turn AS trial, n_original AS words, row_number() OVER (PARTITION BY conv_id ORDER BY (n_original BETWEEN 5 AND 500) DESC, abs(n_original - 100), turn) AS r FROM calls) WHERE r = 1")
def w18(spark, sf):
    rows = calls(spark, sf).select(F.col("conv_id").alias("group_id"), F.col("turn").alias("trial"), F.col("n_original").alias("words"), F.lit(100).alias("target"))
    return audit.best_trial(rows.withColumn("sane", F.col("words").between(5, 500))).select("group_id", "trial", "words")


@query("F31_context_bucket", "WITH " + CALLS_SQL + " SELECT conv_id, turn, coalesce((SELECT min(b) FROM (SELECT unnest([2048, 4096, 8192, 16384, 32768, 65536, 131072, 262144]) AS b) WHERE b >= (n_original + 100) * CAST(1.4 AS DOUBLE)), 262144) AS bucket FROM calls")
def f31(spark, sf):
    sizes = F.array(*(F.lit(1 << k) for k in range(11, 19)))
    fitting = F.array_min(F.filter(sizes, lambda b: b >= (F.col("n_original") + 100) * F.lit(1.4)))
    return calls(spark, sf).select("conv_id", "turn", F.coalesce(fitting, F.lit(1 << 18)).alias("bucket"))


@query("P24_sanity_issues", f"""WITH vocab AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(arg_min(text, turn)), '[a-z'']+')) AS v FROM conversations GROUP BY conv_id),
w AS (SELECT c.conv_id, turn, regexp_extract_all(text, '[A-Za-z'']+') AS words, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n, v FROM conversations c JOIN vocab USING (conv_id)),
t AS (SELECT conv_id, turn, unnest(range(len(words))) AS i, lower(unnest(words)) AS word, v FROM w),
u AS (SELECT conv_id, turn, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS island FROM t WHERE NOT list_contains(v, word) AND word NOT IN ({W.sql_list(W.FUNCTION_WORDS)})),
r AS (SELECT conv_id, turn, max(k) AS run FROM (SELECT conv_id, turn, island, count(*) AS k FROM u GROUP BY ALL) GROUP BY ALL),
g AS (SELECT *, CASE WHEN len(words) >= 12 THEN list_transform(range(1, len(words) - 4), lambda i: array_to_string(list_transform(words, lambda x: lower(x))[i:i + 5], ' ')) ELSE [] END AS grams FROM w)
SELECT g.conv_id, g.turn, array_to_string(list_filter([CASE WHEN len(words) > 0 AND coalesce(run, 0) >= greatest(1, round_even(len(words) / greatest(n, 1), 0)) THEN 'invented_run' END, CASE WHEN list_max(list_transform(words, lambda x: length(x))) > 30 THEN 'long_word' END,
 CASE WHEN len(list_distinct(grams)) < len(grams) THEN 'repeated_phrase' END], lambda x: x IS NOT NULL), ',') AS issues FROM g LEFT JOIN r USING (conv_id, turn)""")
def p24(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    rows = rows.join(first, "conv_id").withColumn("vocabulary", F.regexp_extract_all(F.lower("first"), F.lit("([a-z']+)"), F.lit(1)))
    return audit.sanity_issues(rows).select("conv_id", "turn", F.array_join("issues", ",").alias("issues"))


@query("P25_talk_about_the_text", """SELECT conv_id, turn, regexp_matches(lower(t), '(this|the) (paper|article)|this (section|study|chapter|argument|discussion)|the following sections?|these considerations|the argument|as we have seen|in what follows|we now turn|we conclude|to summarize|in sum|the discussion above|the preceding|the remainder of') AS talk
FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text || ' As We Have seen' WHEN 1 THEN 'In sum, ' || text ELSE text END AS t FROM conversations)""")
def p25(spark, sf):
    planted = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" As We Have seen"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("In sum, "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", sequences.is_talk(planted).alias("talk"))


@query("F34_tolerance", "WITH " + CALLS_SQL + " SELECT conv_id, turn, abs(n_original - 100) <= 0.05 * 100 AS within FROM calls")
def f34(spark, sf):
    return calls(spark, sf).select("conv_id", "turn", (F.abs(F.col("n_original") - 100) <= 5).alias("within"))


@query("J30_mismatches", "WITH " + CALLS_SQL + " SELECT conv_id, turn, category FROM outcomes WHERE (category = 'ok') IS DISTINCT FROM (verdict = 'OK')")
def j30(spark, sf):
    return outcomes(spark, sf).filter(~(F.col("category") == "ok").eqNullSafe(F.col("verdict") == "OK")).select("conv_id", "turn", "category")


@query("S16_resumable_keys", "WITH done AS (SELECT DISTINCT conv_id FROM conversations WHERE turn >= 2) SELECT DISTINCT conv_id FROM conversations ANTI JOIN done USING (conv_id)")
def s16(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id").distinct().join(rows.filter("turn >= 2").select("conv_id").distinct(), "conv_id", "left_anti")


@query("J26_similarity_top_k", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 5) AS dot FROM embeddings, q ORDER BY list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) DESC, vec_id LIMIT 10")
def j26(spark, sf):
    rows = table(spark, sf, "embeddings")
    first = rows.orderBy("vec_id").select(F.col("embedding").alias("e")).limit(1)  # one row
    dot = F.aggregate(F.zip_with("embedding", "e", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rows.join(F.broadcast(first)).select("vec_id", dot.alias("d")).orderBy(F.desc("d"), "vec_id").limit(10).select("vec_id", F.round("d", 5).alias("dot"))
