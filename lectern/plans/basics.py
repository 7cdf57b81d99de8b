"""Queries of cleaning, vocabulary, sentences and phrases over the table of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.functions.porter import stems_sql
from lectern.operators import cleaning, phrases, vocabulary, whole
from lectern.plans.registry import query
from lectern.session import table

STOP = W.sql_list(W.FUNCTION_WORDS)
CONTENT = f"regexp_matches(lower, '^[a-z]+$') AND lower NOT IN ({STOP})"
STEMMED = "stemmed AS (SELECT t.*, stem FROM tokens t JOIN stems USING (lower))"
STEM_COUNTS = f"stem_counts AS (SELECT doc_id, stem, count(*) AS cnt, min(pos) AS first_pos FROM stemmed WHERE {CONTENT} GROUP BY ALL)"
SHARE, MOST = 0.9, 150
TOP = f"""top AS (SELECT doc_id, stem, cnt, first_pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS rank,
  count(*) OVER (PARTITION BY doc_id) AS n FROM stem_counts) WHERE rank <= least(ceil(n * (1 - CAST({SHARE} AS DOUBLE))), {MOST}))"""
UPTO_TOP = W.with_sql("tokens", stems_sql(), STEMMED, STEM_COUNTS, TOP)


def docs_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def stemmed_of(spark, sf):
    return vocabulary.stemmed_tokens(docs_of(spark, sf))


def top_of(spark, sf):
    return vocabulary.rank_cut(vocabulary.stem_counts(stemmed_of(spark, sf)), SHARE, MOST)


@query("S01_text_scan", "SELECT doc_id, length(text) AS chars, sha256(text) AS digest FROM documents")
def s01(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


@query("S04_newlines", r"SELECT doc_id, md5(replace(replace(text || chr(13) || chr(10) || 'x' || chr(13) || 'y', chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def s04(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(cleaning.normalize_newlines(F.concat("text", F.lit("\r\nx\ry")))).alias("digest"))


@query("P01_page_number_lines", W.with_sql("lines") + rf"SELECT doc_id, count(*) AS kept FROM lines WHERE NOT regexp_matches(line, '{cleaning.PAGE_NUMBER}') GROUP BY doc_id")
def p01(spark, sf):
    return cleaning.drop_page_numbers(W.lines(docs_of(spark, sf))).groupBy("doc_id").agg(F.count("*").alias("kept"))


# Written out here, so that the SQL does not share the operator's patterns.
_TAGS = r"""list_filter([CASE WHEN regexp_matches(line, '(?i)^(original research|[a-z][a-z]+\s+\([0-9]{4}\)|https://doi\.org/)') THEN 'journal_masthead' END,
 CASE WHEN regexp_matches(line, '(?i)^received:.*accepted:') THEN 'article_history' END, CASE WHEN regexp_matches(line, '(?i)(^©|under exclusive licence|springer nature)') THEN 'copyright_notice' END,
 CASE WHEN starts_with(lower(line), 'acm reference format') THEN 'acm_reference_format' END, CASE WHEN starts_with(lower(line), 'ccs concepts') THEN 'ccs_concepts' END,
 CASE WHEN regexp_matches(line, '(?i)^keywords\b') THEN 'keywords_heading' END, CASE WHEN regexp_matches(line, '(?i)^abstract\b') THEN 'abstract_heading' END,
 CASE WHEN regexp_matches(line, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+') THEN 'email' END, CASE WHEN regexp_matches(line, '(?i)(universit|cnrs|department of)') THEN 'affiliation' END], lambda x: x IS NOT NULL)"""
_HEADING = r"^\s*([0-9]+(\.[0-9]+)?\.?\s*)?Introduction\b"
_NOTES = "lower(trim(line, ' ' || chr(9) || chr(13))) IN ('notes', 'footnote', 'footnotes', 'references', 'bibliography')"
#: Lines of texts with planted front matter, headings and notes, since the tables' texts have none.
_PLANTED = r"""planted AS (SELECT doc_id, concat('Minds (2024)', chr(10), 'Received: 1 May / Accepted: 2 June', chr(10), 'a.b@c-d.org', chr(10), 'Plain line', chr(10), 'abstract', chr(10), '  1.2 Introduction', chr(10), 'Department of X',
 chr(10), text, chr(10), ' Footnotes ', chr(10), 'last') AS text FROM documents)"""
_PLANTED_LINES = "WITH " + _PLANTED + ", lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM planted)))"


def planted_of(spark, sf):
    head = "Minds (2024)\nReceived: 1 May / Accepted: 2 June\na.b@c-d.org\nPlain line\nabstract\n  1.2 Introduction\nDepartment of X\n"
    return docs_of(spark, sf).select("doc_id", F.concat(F.lit(head), "text", F.lit("\n Footnotes \nlast")).alias("text"))


@query("P02_front_matter", _PLANTED_LINES + f""", starts AS (SELECT doc_id, min(line_no) AS start FROM lines WHERE regexp_matches(line, '{_HEADING}') GROUP BY doc_id),
marked AS (SELECT *, len({_TAGS}) > 0 AS mark FROM lines)
SELECT doc_id, count(*) AS kept, CAST(sum(line_no) AS BIGINT) AS places, md5(string_agg(line, '|' ORDER BY line_no)) AS digest FROM marked LEFT JOIN starts USING (doc_id)
WHERE line_no >= start OR NOT mark GROUP BY doc_id""")
def p02(spark, sf):
    rows = cleaning.drop_front_matter(W.lines(planted_of(spark, sf)))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "|")
    return rows.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("line_no").alias("places"), F.md5(text).alias("digest"))


@query("P02b_front_matter_hits", _PLANTED_LINES + f" SELECT doc_id, line_no, unnest({_TAGS}) AS tag, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines")
def p02b(spark, sf):
    return cleaning.front_matter_hits(W.lines(planted_of(spark, sf)))


@query("P03_end_sections", _PLANTED_LINES + f""", ends AS (SELECT doc_id, min(line_no) AS stop FROM lines WHERE {_NOTES} GROUP BY doc_id)
SELECT doc_id, count(*) AS kept FROM lines LEFT JOIN ends USING (doc_id) WHERE stop IS NULL OR line_no < stop GROUP BY doc_id""")
def p03(spark, sf):
    return cleaning.drop_end_sections(W.lines(planted_of(spark, sf))).groupBy("doc_id").agg(F.count("*").alias("kept"))


_NORM = r"regexp_replace(trim(line), '\d+', 'N', 'g')"


@query("A09_recurring_lines", W.with_sql("lines") + f"SELECT doc_id, {_NORM} AS norm, count(*) AS n FROM lines WHERE length({_NORM}) BETWEEN 1 AND 80 GROUP BY ALL HAVING count(*) >= 3")
def a09(spark, sf):
    return cleaning.recurring_lines(W.lines(docs_of(spark, sf)))


@query("J04_drop_recurring_lines", W.with_sql("lines") + f"SELECT doc_id, line_no FROM (SELECT *, {_NORM} AS norm, count(*) OVER (PARTITION BY doc_id, {_NORM}) AS n FROM lines) WHERE length(norm) NOT BETWEEN 1 AND 80 OR n < 3")
def j04(spark, sf):
    return cleaning.drop_recurring_lines(W.lines(docs_of(spark, sf))).select("doc_id", "line_no")


@query("F01_join_hyphenated", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'ing (\w)', 'ing-' || chr(10) || ' \1', 'g'), '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g')) AS digest FROM documents")
def f01(spark, sf):
    broken = F.regexp_replace("text", r"ing (\w)", "ing-\n $1")
    return docs_of(spark, sf).select("doc_id", F.md5(cleaning.join_hyphenated(broken)).alias("digest"))


# RE2 looks neither back nor ahead: both neighbours are taken along, and digits are first replaced by a mark that counts as
# a digit, twice, since a neighbour may belong to two places.
_CALLS = "'(^|[^0-9\x01])([A-Za-z)\\]''’.,;:!?])([0-9]{1,2})([^0-9]|$)'"
_FOOTNOTES = lambda t: f"replace(regexp_replace(regexp_replace({t}, {_CALLS}, '\\1\\2\x01\\4', 'g'), {_CALLS}, '\\1\\2\x01\\4', 'g'), '\x01', '')"
_CALLED = r"regexp_replace(text, '([a-z])(,| )', '\1' || (doc_id % 150) || '\2', 'g')"


@query("F02_footnote_calls", f"SELECT doc_id, md5({_FOOTNOTES(_CALLED)}) AS digest FROM documents")
def f02(spark, sf):
    called = F.regexp_replace(F.col("text"), F.lit("([a-z])(,| )"), F.concat(F.lit("$1"), (F.col("doc_id") % 150).cast("string"), F.lit("$2")))
    return docs_of(spark, sf).select("doc_id", F.md5(cleaning.drop_footnote_calls(called)).alias("digest"))


@query("F03_squeeze_blanks", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS digest FROM documents")
def f03(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(cleaning.squeeze(F.col("text"))).alias("digest"))


_JOINED = r"regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g')"


@query("F04_clean", "WITH " + _PLANTED + f""", called AS (SELECT doc_id, {_FOOTNOTES(_JOINED)} AS text FROM planted),
lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM called))),
starts AS (SELECT doc_id, min(line_no) AS start FROM lines WHERE regexp_matches(line, '{_HEADING}') GROUP BY doc_id), body AS (SELECT doc_id, line_no, line FROM lines LEFT JOIN starts USING (doc_id) WHERE line_no >= start OR len({_TAGS}) = 0),
ends AS (SELECT doc_id, min(line_no) AS stop FROM body WHERE {_NOTES} GROUP BY doc_id),
short AS (SELECT doc_id, line_no, line, regexp_replace(trim(line), '[0-9]+', 'N', 'g') AS norm FROM body LEFT JOIN ends USING (doc_id) WHERE (stop IS NULL OR line_no < stop) AND NOT regexp_matches(line, '^\\s*[0-9]{{1,4}}\\s*$')),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS n FROM short) WHERE length(norm) NOT BETWEEN 1 AND 80 OR n < 3),
whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id),
done AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10) AS text FROM whole)
SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM done""")
def f04(spark, sf):
    return cleaning.clean(planted_of(spark, sf)).select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("F06_digit_form", W.with_sql("lines") + f"SELECT doc_id, line_no, {_NORM} AS norm FROM lines WHERE regexp_matches(line, '[0-9]')")
def f06(spark, sf):
    return W.lines(docs_of(spark, sf)).filter(F.col("line").rlike("[0-9]")).select("doc_id", "line_no", cleaning.digit_form(F.col("line")).alias("norm"))


@query("J31_split_glued_words", W.with_sql("tokens") + """, counts AS (SELECT lower AS word, count(*) AS n FROM tokens WHERE regexp_matches(lower, '^[a-z]+$') GROUP BY lower),
dictionary AS (SELECT word FROM counts WHERE n >= 20), unknown AS (SELECT word FROM counts WHERE length(word) >= 8 AND n < 20),
parts AS (SELECT word, unnest(range(3, length(word) - 3)) AS p FROM unknown),
known AS (SELECT word, p, left(word, p) AS left_part, substr(word, p + 1) AS right_part FROM parts WHERE left(word, p) IN (SELECT word FROM dictionary) AND substr(word, p + 1) IN (SELECT word FROM dictionary))
SELECT word, arg_min(left_part, p) AS left_part, arg_min(right_part, p) AS right_part FROM known GROUP BY word""")
def j31(spark, sf):
    counts = W.tokens(docs_of(spark, sf)).filter(F.col("lower").rlike("^[a-z]+$")).groupBy(F.col("lower").alias("word")).count()
    return cleaning.split_glued_words(counts.select("word"), counts.filter("count >= 20").select("word"))


_GLUED = r"regexp_replace(text, '([a-z]{3,}) ([a-z]{4,}) ', '\1\2 ', 'g')"


@query("J31_rewritten_texts", f"""WITH glued AS (SELECT doc_id, {_GLUED} AS text FROM documents), pieces AS (SELECT doc_id, i, p[i] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+)') AS p FROM glued))),
dictionary AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents) WHERE regexp_matches(word, '^[a-z]+$') GROUP BY word HAVING count(*) >= 20),
long AS (SELECT DISTINCT lower(piece) AS word FROM pieces WHERE regexp_matches(piece, '^[A-Za-z]{{8,}}$') AND lower(piece) NOT IN (SELECT word FROM dictionary)),
places AS (SELECT word, min(p) AS p FROM (SELECT word, unnest(range(3, length(word) - 3)) AS p FROM long) WHERE left(word, p) IN (SELECT word FROM dictionary) AND substr(word, p + 1) IN (SELECT word FROM dictionary) GROUP BY word)
SELECT doc_id, md5(string_agg(CASE WHEN p IS NULL THEN piece ELSE left(piece, p) || ' ' || substr(piece, p + 1) END, '' ORDER BY i)) AS digest FROM pieces LEFT JOIN places ON word = lower(piece) AND regexp_matches(piece, '^[A-Za-z]{{8,}}$') GROUP BY doc_id""")
def j31_texts(spark, sf):
    known = W.tokens(docs_of(spark, sf)).filter(F.col("lower").rlike("^[a-z]+$")).groupBy(F.col("lower").alias("word")).count().filter("count >= 20").select("word")
    glued = docs_of(spark, sf).select("doc_id", F.regexp_replace("text", "([a-z]{3,}) ([a-z]{4,}) ", "$1$2 ").alias("text"))
    return cleaning.rewrite_glued_words(glued, known).select("doc_id", F.md5("text").alias("digest"))


@query("F05_html_to_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'),
 '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def f05(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(cleaning.html_to_text(F.col("html"))).alias("digest"))


@query("F05_markdown_to_prose")
def f05b(spark, sf):
    marked = F.concat(F.lit("# Title\n\n> *quoted* **text**\n\n- item [link](http://x)\n\n"), F.col("text"))
    return docs_of(spark, sf).select("doc_id", F.md5(cleaning.markdown_to_prose(marked)).alias("digest"))


@query("F17_html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""")
def f17(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(cleaning.escape_html(F.col("html"))).alias("digest"))


@query("F10_tokens", W.with_sql("tokens") + "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT lower) AS n_distinct, max(pos) AS last FROM tokens GROUP BY doc_id")
def f10(spark, sf):
    return W.tokens(docs_of(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("lower").alias("n_distinct"), F.max("pos").alias("last"))


@query("P04_content_tokens", W.with_sql("tokens") + f"SELECT doc_id, count(*) AS n FROM tokens WHERE {CONTENT} GROUP BY doc_id")
def p04(spark, sf):
    return W.tokens(docs_of(spark, sf)).filter(vocabulary.is_content()).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("P05_alphabetic_tokens", W.with_sql("tokens") + "SELECT doc_id, count(*) AS n FROM tokens WHERE regexp_matches(lower, '^[a-z]+$') GROUP BY doc_id")
def p05(spark, sf):
    return W.tokens(docs_of(spark, sf)).filter(F.col("lower").rlike("^[a-z]+$")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("P06_dense_lemma_positions", W.with_sql("tokens", stems_sql(), STEMMED) + f"SELECT doc_id, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(dense * length(stem)) AS BIGINT) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS dense FROM stemmed WHERE {CONTENT}) GROUP BY doc_id")
def p06(spark, sf):
    from pyspark.sql import Window

    rows = stemmed_of(spark, sf).filter(vocabulary.is_content()).withColumn("dense", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return rows.groupBy("doc_id").agg(F.sum("pos").alias("places"), F.sum(F.col("dense") * F.length("stem")).alias("weighted"))


@query("F12_stems", W.with_sql("tokens", stems_sql()) + "SELECT lower, stem FROM stems")
def f12(spark, sf):
    from lectern.functions.porter import stems

    return stems(W.tokens(docs_of(spark, sf)))


@query("A01_stem_counts", W.with_sql("tokens", stems_sql(), STEMMED, STEM_COUNTS) + "SELECT * FROM stem_counts")
def a01(spark, sf):
    return vocabulary.stem_counts(stemmed_of(spark, sf))


@query("A02_words_of_stems", W.with_sql("tokens", stems_sql(), STEMMED) + "SELECT stem, lower AS word, count(*) AS cnt FROM stemmed GROUP BY ALL")
def a02(spark, sf):
    return stemmed_of(spark, sf).groupBy("stem", F.col("lower").alias("word")).agg(F.count("*").alias("cnt"))


@query("A03_vocabulary_size", W.with_sql("tokens", stems_sql(), STEMMED) + f"SELECT doc_id, count(DISTINCT stem) AS n_stems FROM stemmed WHERE {CONTENT} GROUP BY doc_id")
def a03(spark, sf):
    return stemmed_of(spark, sf).filter(vocabulary.is_content()).groupBy("doc_id").agg(F.count_distinct("stem").alias("n_stems"))


@query("W01_rank_fraction_cutoff", UPTO_TOP + "SELECT doc_id, stem, cnt, first_pos, rank FROM top")
def w01(spark, sf):
    return top_of(spark, sf)


@query("O01_corpus_vocabulary", W.with_sql("tokens", stems_sql(), STEMMED) + f"SELECT stem, count(*) AS cnt FROM stemmed WHERE {CONTENT} GROUP BY stem ORDER BY cnt DESC, stem LIMIT 150")
def o01(spark, sf):
    return vocabulary.corpus_stems(stemmed_of(spark, sf), SHARE, MOST)


@query("P22_cap_note", W.with_sql("tokens", stems_sql(), STEMMED) + f"SELECT doc_id, n_stems, CASE WHEN ceil(n_stems * (1 - CAST({SHARE} AS DOUBLE))) > 20 THEN 'cap' ELSE 'share' END AS bound FROM (SELECT doc_id, count(DISTINCT stem) AS n_stems FROM stemmed WHERE {CONTENT} GROUP BY doc_id)")
def p22(spark, sf):
    n = stemmed_of(spark, sf).filter(vocabulary.is_content()).groupBy("doc_id").agg(F.count_distinct("stem").alias("n_stems"))
    return n.withColumn("bound", F.when(F.ceil(F.col("n_stems") * (F.lit(1.0) - F.lit(SHARE))) > 20, "cap").otherwise("share"))


OCCURRENCES = "occ AS (SELECT s.* FROM stemmed s JOIN top USING (doc_id, stem) WHERE regexp_matches(s.lower, '^[a-z]+$'))"


@query("J01_stem_occurrences", UPTO_TOP.rstrip() + ", " + OCCURRENCES + " SELECT doc_id, stem, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM occ GROUP BY ALL")
def j01(spark, sf):
    rows = stemmed_of(spark, sf)
    top = vocabulary.rank_cut(vocabulary.stem_counts(rows), SHARE, MOST)
    return vocabulary.occurrences(rows, top).groupBy("doc_id", "stem").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query("W02_words_a_stem_cut", W.with_sql("tokens", stems_sql(), STEMMED) + """SELECT doc_id, stem, word, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stem ORDER BY cnt DESC, first_pos) AS rank, count(*) OVER (PARTITION BY doc_id, stem) AS n
FROM (SELECT doc_id, stem, lower AS word, count(*) AS cnt, min(pos) AS first_pos FROM stemmed GROUP BY ALL)) WHERE rank <= greatest(ceil(n * (1 - CAST(0.7 AS DOUBLE))), 1)""")
def w02(spark, sf):
    return vocabulary.words_of_stems(stemmed_of(spark, sf), 0.7, 1)


@query("W03_first_occurrences", UPTO_TOP.rstrip() + ", " + OCCURRENCES + " SELECT doc_id, stem, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stem ORDER BY pos) AS n FROM occ) WHERE n <= 3")
def w03(spark, sf):
    rows = stemmed_of(spark, sf)
    top = vocabulary.rank_cut(vocabulary.stem_counts(rows), SHARE, MOST)
    return vocabulary.first_occurrences(vocabulary.occurrences(rows, top), 3).select("doc_id", "stem", "pos", "n")


@query("A13_parameter_sweep", W.with_sql("tokens", stems_sql(), STEMMED, STEM_COUNTS) + """, tried AS (SELECT doc_id, stem, share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS rank, count(*) OVER (PARTITION BY doc_id) AS n FROM stem_counts),
(SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.75 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS share) WHERE rank <= ceil(n * (1 - share)))
SELECT doc_id, share, count(DISTINCT stem) AS n_stems, count(DISTINCT lower) AS n_words, count(*) AS n_hits FROM stemmed JOIN tried USING (doc_id, stem) WHERE regexp_matches(lower, '^[a-z]+$') GROUP BY ALL""")
def a13(spark, sf):
    return vocabulary.sweep(stemmed_of(spark, sf), [0.5, 0.75, 0.9])


@query("F07_word_count", f"SELECT doc_id, len({W.word_array_sql('text')}) AS n_words FROM documents")
def f07(spark, sf):
    return docs_of(spark, sf).select("doc_id", W.word_count(F.col("text")).alias("n_words"))


@query("F08_target_words", f"SELECT doc_id, CAST(greatest(1, round(len({W.word_array_sql('text')}) * 25 / 100.0)) AS BIGINT) AS target FROM documents")
def f08(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.greatest(F.lit(1), F.round(W.word_count(F.col("text")) * 25 / 100.0)).cast("long").alias("target"))


@query("F09_sentences", W.with_sql("sentences") + "SELECT doc_id, sent_id, md5(sentence) AS digest FROM sentences")
def f09(spark, sf):
    return W.sentences(docs_of(spark, sf)).select("doc_id", "sent_id", F.md5("sentence").alias("digest"))


@query("U04_distinct_sentences", W.with_sql("sentences") + "SELECT DISTINCT sentence FROM sentences")
def u04(spark, sf):
    return W.sentences(docs_of(spark, sf)).select("sentence").distinct()


@query("A20_document_profile", f"SELECT d.doc_id, len({W.word_array_sql('text')}) AS n_words, coalesce(u, 0) AS n_unique FROM documents d LEFT JOIN ({W.with_sql('tokens')} SELECT doc_id, count(DISTINCT lower) AS u FROM tokens WHERE regexp_matches(lower, '^[a-z]+$') GROUP BY doc_id) USING (doc_id)")
def a20(spark, sf):
    unique = F.array_distinct(F.filter(F.expr(f"regexp_extract_all(lower(text), \"({W.TOKEN})\", 1)"), lambda t: t.rlike("^[a-z]+$")))
    return docs_of(spark, sf).select("doc_id", W.word_count(F.col("text")).alias("n_words"), F.size(unique).cast("long").alias("n_unique"))


GRAMS = """grams AS (SELECT doc_id, CAST(n AS INT) AS n, CAST(p AS INT) AS pos, array_to_string(w[p + 1:p + n], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS p
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z'']+') AS w FROM documents), (SELECT unnest(range({low}, {high} + 1)) AS n) WHERE len(w) >= n)),
gram_counts AS MATERIALIZED (SELECT doc_id, n, gram, count(*) AS cnt, min(pos) AS first_pos FROM grams GROUP BY ALL HAVING count(*) >= 2)"""


def grams_sql(low, high):
    return GRAMS.format(low=low, high=high)


@query("W04_ngrams", "WITH " + grams_sql(2, 3) + " SELECT n, gram, count(*) AS cnt FROM grams GROUP BY ALL HAVING count(*) >= 2")
def w04(spark, sf):
    return phrases.grams(docs_of(spark, sf), range(2, 4)).groupBy("n", "gram").agg(F.count("*").alias("cnt")).filter("cnt >= 2")


@query("A04_ngrams_of_distinct_sentences", W.with_sql("sentences") + """, d AS (SELECT DISTINCT sentence FROM sentences), g AS (SELECT array_to_string(w[p + 1:p + n], ' ') AS gram FROM (SELECT n, w, unnest(range(0, len(w) - n + 1)) AS p
 FROM (SELECT regexp_extract_all(lower(sentence), '[A-Za-z'']+') AS w FROM d), (SELECT unnest([2, 3]) AS n) WHERE len(w) >= n)) SELECT gram, count(*) AS cnt FROM g GROUP BY gram HAVING count(*) >= 2""")
def a04(spark, sf):
    distinct = W.sentences(docs_of(spark, sf)).select(F.lit(0).alias("doc_id"), F.col("sentence").alias("text")).distinct()
    return phrases.grams(distinct, range(2, 4)).groupBy("gram").agg(F.count("*").alias("cnt")).filter("cnt >= 2")


@query("A06_ngram_threshold", "WITH " + grams_sql(2, 3) + " SELECT doc_id, coalesce(quantile_cont(cnt, 0.95), 0.0) AS threshold, count(*) AS n_grams FROM gram_counts GROUP BY doc_id")
def a06(spark, sf):
    counts = phrases.gram_counts(phrases.grams(docs_of(spark, sf), range(2, 4)))
    return counts.groupBy("doc_id").agg(F.coalesce(F.percentile("cnt", 0.95), F.lit(0.0)).alias("threshold"), F.count("*").alias("n_grams"))


MAXIMAL = """inside AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + m], ' ') AS gram FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS p
 FROM (SELECT doc_id, string_split(gram, ' ') AS w, unnest(range(1, n)) AS m FROM gram_counts))), kept AS (SELECT * FROM gram_counts ANTI JOIN inside USING (doc_id, gram))"""


@query("L02_maximal_phrases", "WITH " + grams_sql(2, 4) + ", " + MAXIMAL + " SELECT * FROM kept")
def l02(spark, sf):
    return phrases.maximal(phrases.recurring_counts(whole.dealt(docs_of(spark, sf)), range(2, 5)), 4)


@query("O07_top_phrases", "WITH " + grams_sql(2, 4) + ", " + MAXIMAL + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, n DESC, first_pos) AS rank FROM kept) WHERE rank <= 25")
def o07(spark, sf):
    return phrases.top_phrases(phrases.maximal(phrases.recurring_counts(whole.dealt(docs_of(spark, sf)), range(2, 5)), 4), 25)


@query("A25_most_repeated_6gram", "WITH " + grams_sql(6, 6) + " SELECT doc_id, gram, cnt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS r FROM gram_counts) WHERE r = 1")
def a25(spark, sf):
    return phrases.top_phrases(phrases.gram_counts(phrases.grams(docs_of(spark, sf), range(6, 7))), 1).select("doc_id", "gram", "cnt")


@query("A43_gram_totals", "WITH " + grams_sql(2, 3) + " SELECT n, count(*) AS total, count(DISTINCT gram) AS different FROM grams GROUP BY n")
def a43(spark, sf):
    return phrases.grams(docs_of(spark, sf), range(2, 4)).groupBy("n").agg(F.count("*").alias("total"), F.count_distinct("gram").alias("different"))
