"""Queries of smaller operators: selections, lists, chunks, colours, names, alignments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import audit, reading, sequences, verification, vocabulary
from lectern.plans.analysis import CLUSTERS, CONTENT_WORDS, parts
from lectern.plans.audits import CALLS_SQL, DOMAIN, calls, outcomes
from lectern.plans.basics import STOP, UPTO_TOP, docs_of
from lectern.plans.registry import query
from lectern.session import table

UPTO = UPTO_TOP.rstrip() + ",\n" + CLUSTERS


@query("P17_index_selection", UPTO + " SELECT doc_id, cluster, string_agg(stem, ' ' ORDER BY i) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY rank) AS i FROM clusters) WHERE i NOT IN (2, 4) GROUP BY ALL")
def p17(spark, sf):
    _, top = parts(spark, sf)
    lists = vocabulary.pseudo_clusters(top).groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "stem"))).alias("items"))
    kept = F.filter(F.col("items.stem"), lambda x, i: ~(i + 1).isin(2, 4))
    return lists.select("doc_id", "cluster", F.array_join(kept, " ").alias("kept"))


@query("A24_stems_in_clusters", UPTO + ", twice AS (SELECT doc_id, stem, cluster FROM clusters UNION ALL SELECT doc_id, stem, 'other' FROM clusters WHERE rank % 4 = 0) SELECT doc_id, stem, string_agg(cluster, ',' ORDER BY cluster) AS clusters FROM twice GROUP BY ALL HAVING count(*) > 1")
def a24(spark, sf):
    _, top = parts(spark, sf)
    clusters = vocabulary.pseudo_clusters(top)
    twice = clusters.select("doc_id", "stem", "cluster").unionByName(clusters.filter("rank % 4 = 0").select("doc_id", "stem", F.lit("other").alias("cluster")))
    found = twice.groupBy("doc_id", "stem").agg(F.array_sort(F.collect_list("cluster")).alias("c")).filter(F.size("c") > 1)
    return found.select("doc_id", "stem", F.array_join("c", ",").alias("clusters"))


@query("F38_palette", UPTO + " SELECT DISTINCT doc_id, cluster, CAST((dense_rank() OVER (PARTITION BY doc_id ORDER BY cluster) - 1) % 20 AS INT) AS colour FROM clusters")
def f38(spark, sf):
    _, top = parts(spark, sf)
    names = vocabulary.pseudo_clusters(top).select("doc_id", "cluster").distinct()
    return names.withColumn("colour", ((F.row_number().over(Window.partitionBy("doc_id").orderBy("cluster")) - 1) % 20).cast("int"))


@query("U01_stopwords", W.with_sql("tokens") + f""", names AS (SELECT doc_id, lower(token) AS word FROM tokens WHERE pos > 0 AND regexp_matches(token, '^[A-Z][a-z]+$') GROUP BY doc_id, token HAVING count(*) >= 3),
numerals AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents), base AS (SELECT doc_id, unnest([{STOP}, 'et', 'al', 'ibid', 'eg', 'ie', 'etc', 'cf', 'op', 'cit', 'vol', 'no', 'pp']) AS word FROM documents),
every AS (SELECT * FROM names UNION SELECT * FROM numerals WHERE regexp_matches(word, '^[0-9]+[a-z]?$') UNION SELECT * FROM base)
SELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY word)) AS digest FROM every GROUP BY doc_id""")
def u01(spark, sf):
    return vocabulary.stopwords(docs_of(spark, sf)).select("doc_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


@query("A22_name_mentions", W.with_sql("tokens") + "SELECT doc_id, token AS name, count(*) AS n FROM tokens WHERE pos > 0 AND regexp_matches(token, '^[A-Z][a-z]+$') GROUP BY ALL HAVING count(*) >= 3")
def a22(spark, sf):
    return W.tokens(docs_of(spark, sf)).filter((F.col("pos") > 0) & F.col("token").rlike("^[A-Z][a-z]+$")).groupBy("doc_id", F.col("token").alias("name")).agg(F.count("*").alias("n")).filter("n >= 3")


@query("A42_numerals", r"SELECT DISTINCT unnest(regexp_extract_all(text, '\b\d+[a-z]?\b')) AS numeral FROM documents")
def a42(spark, sf):
    return docs_of(spark, sf).select(F.explode(F.expr(r"regexp_extract_all(text, '\\b\\d+[a-z]?\\b', 0)")).alias("numeral")).distinct()


@query("F11_content_words", f"SELECT doc_id, len({CONTENT_WORDS}) AS n FROM documents")
def f11(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.size(verification.content_words(F.col("text"))).cast("long").alias("n"))


@query("F23_chunks", f"""WITH marked AS (SELECT doc_id, regexp_replace(text, '[.] (A|E|T)', '.' || chr(10) || ' ' || chr(10) || '\\1', 'g') AS text FROM documents),
paragraphs AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS text FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS p FROM marked)), w AS (SELECT doc_id, i, {W.word_array_sql('text')} AS w FROM paragraphs),
cut AS (SELECT doc_id, i, w, unnest(range(0, len(w), 120)) AS start FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, start) - 1 AS INT) AS chunk, md5(array_to_string(w[start + 1:start + 120], ' ')) AS digest FROM cut""")
def f23(spark, sf):
    marked = F.regexp_replace("text", "[.] (A|E|T)", ".\n \n$1")
    return docs_of(spark, sf).select("doc_id", F.posexplode(W.paragraph_chunks(marked, 120)).alias("chunk", "text")).select("doc_id", "chunk", F.md5("text").alias("digest"))


@query("F24_substring_count", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def f24(spark, sf):
    return docs_of(spark, sf).select("doc_id", ((F.length("text") - F.length(F.replace(F.col("text"), F.lit("the"), F.lit("")))) / 3).cast("long").alias("n"))


@query("F14_word_search", r"SELECT doc_id, regexp_matches(text, '(?i)\bthe\b') AS found FROM documents")
def f14(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.col("text").rlike(r"(?i)\b\Qthe\E\b").alias("found"))


@query("F18_hex_to_rgb", "SELECT doc_id, CAST('0x' || substr(md5(text), 1, 2) AS INT) AS r, CAST('0x' || substr(md5(text), 3, 2) AS INT) AS g, CAST('0x' || substr(md5(text), 5, 2) AS INT) AS b FROM documents")
def f18(spark, sf):
    part = lambda i: F.conv(F.substring(F.md5("text"), i, 2), 16, 10).cast("int")
    return docs_of(spark, sf).select("doc_id", part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


@query("F20_metadata_lines", r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(t, '(?im)^\s*TITLE:[ \t]*(.*)$', 1)), ''), 'Unclear') AS title, coalesce(nullif(trim(regexp_extract(t, '(?im)^\s*AUTHOR[^:\n]*:[ \t]*(.*)$', 1)), ''), 'Unclear') AS author,
 coalesce(nullif(trim(regexp_extract(t, '(?im)^\s*DATE:[ \t]*(.*)$', 1)), ''), 'Unclear') AS date FROM (SELECT doc_id, 'Title: d' || doc_id || chr(10) || 'author(s): ' || lang || chr(10) || 'DATE: ' || CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE '' END || chr(10) || text AS t FROM documents)""")
def f20(spark, sf):
    year = F.when(F.col("doc_id") % 2 == 0, "2024").otherwise("")
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Title: d"), "doc_id", F.lit("\nauthor(s): "), "lang", F.lit("\nDATE: "), year, F.lit("\n"), "text").alias("t"))
    line = lambda name: F.coalesce(F.nullif(F.trim(F.regexp_extract("t", rf"(?im)^\s*{name}:[ \t]*(.*)$", 1)), F.lit("")), F.lit("Unclear"))
    return rows.select("doc_id", line("TITLE").alias("title"), line(r"AUTHOR[^:\n]*").alias("author"), line("DATE").alias("date"))


@query("F32_softmax", "SELECT vec_id, round(1 / (1 + exp(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))), 6) AS p FROM embeddings")
def f32(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(F.col("embedding")[0].cast("double") - F.col("embedding")[1].cast("double"))), 6).alias("p"))


@query("F33_normalised_dot", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e), q AS (SELECT v AS w, norm AS size FROM n ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) / (norm * size), 5) AS dot FROM n, q""")
def f33(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", verification.normalised(F.col("embedding")).alias("v"))
    first = rows.orderBy("vec_id").select(F.col("v").alias("w")).limit(1)  # one row
    return rows.join(F.broadcast(first)).select("vec_id", F.round(verification.dot(F.col("v"), F.col("w")), 5).alias("dot"))


@query("A14_span_pivot", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system FROM conversations GROUP BY conv_id")
def a14(spark, sf):
    kinds = ["user", "assistant", "system"]
    return table(spark, sf, "conversations").groupBy("conv_id").pivot("role", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query("A34_integrity", "WITH " + CALLS_SQL + " SELECT condition, count(*) AS n, max(length(response)) AS most, count(*) FILTER (WHERE failed) AS failures FROM calls GROUP BY condition")
def a34(spark, sf):
    return calls(spark, sf).groupBy("condition").agg(F.count("*").alias("n"), F.max(F.length("response")).cast("long").alias("most"), F.count_if("failed").alias("failures"))


@query("A29_outcome_counts", "WITH " + CALLS_SQL + """, names AS (SELECT unnest(['call_failed', 'empty_response', 'unparseable', 'fixed_no_text', 'fixed_rejected_short', 'fixed_identical', 'fixed_expanded', 'ok', 'fixed_changed']) AS category),
conditions AS (SELECT DISTINCT condition FROM calls) SELECT condition, category, count(conv_id) AS k FROM conditions CROSS JOIN names LEFT JOIN outcomes USING (condition, category) GROUP BY ALL""")
def a29(spark, sf):
    return audit.shares(outcomes(spark, sf), ["condition"], "category", DOMAIN).select("condition", "category", "k")


@query("W13_share_of_total", "SELECT lang, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM documents GROUP BY lang")
def w13(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # a row a language


@query("J29_fallback_text", "WITH firsts AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id) SELECT c.conv_id, turn, md5(coalesce(CASE WHEN turn % 2 = 0 THEN text END, t)) AS digest FROM conversations c LEFT JOIN firsts USING (conv_id)")
def j29(spark, sf):
    rows = table(spark, sf, "conversations")
    firsts = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return rows.join(firsts, "conv_id", "left").select("conv_id", "turn", F.md5(F.coalesce(F.when(F.col("turn") % 2 == 0, F.col("text")), "t")).alias("digest"))


@query("F37_word_similarity")
def f37(spark, sf):
    rows = calls(spark, sf).filter("n_fixed > 0").withColumn("s", sequences.word_similarity("original", "fixed"))
    return rows.select("conv_id", "turn", F.round("s.ratio", 6).alias("ratio"), F.round("s.containment", 6).alias("containment"))


def spans_of(spark, sf):
    """Sentences of the conversations' last turns, with the best sentence of what was said before in each."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    last = rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))
    before = rows.join(last.select("conv_id", F.col("turn").alias("end")), "conv_id").filter("turn < end")
    whole = before.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("whole"))
    cut = lambda t: F.posexplode(W.sentence_array(F.col(t)))
    spans = last.select("conv_id", cut("text").alias("i", "text")).select(F.struct("conv_id", "i").alias("span_id"), "conv_id", F.trim("text").alias("text"))
    sources = whole.select("conv_id", cut("whole").alias("src_id", "source"))
    best = verification.best_sentences(spans, sources)
    return spans.join(whole, "conv_id").join(best, "span_id", "left")


@query("L08_span_classes")
def l08(spark, sf):
    found = sequences.classify_spans(spans_of(spark, sf))
    return found.select("span_id.conv_id", "span_id.i", "kind", "basis", F.size("added").alias("n_added"))


@query("L10_borderline_flags")
def l10(spark, sf):
    found = sequences.borderline_flags(sequences.classify_spans(spans_of(spark, sf)))
    return found.select("span_id.conv_id", "span_id.i", "kind", "basis", "against")


@query("A37_permutation_p")
def a37(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return sequences.permutation_p(rows, "lang", "quality", 10_000)
