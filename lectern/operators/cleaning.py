"""Removal of extraction artefacts from raw texts (line based), and conversion of markup to prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.words import lines

PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
#: The reference patterns are those of Python: letters of any script are letters, and only a newline ends a line.
UNICODE, NO_CASE = "(?dU)", "(?diuU)"
# Headings where the body starts and where the notes start, and the marks of front-matter lines by tag.
HEADING = r"^\s*(?:\d+(?:\.\d+)?\.?\s*)?Introduction\b"
NOTES_HEADINGS = (r"^\s*notes\s*$", r"^\s*footnotes?\s*$", r"^\s*references\s*$", r"^\s*bibliography\s*$")
FRONT_MATTER = {
    "journal_masthead": NO_CASE + r"^(ORIGINAL RESEARCH|[A-Z][a-z]+\s+\(\d{4}\)|https://doi\.org/)",
    "article_history": NO_CASE + r"^Received:.*Accepted:",
    "copyright_notice": NO_CASE + r"^©|under exclusive licence|Springer Nature",
    "acm_reference_format": NO_CASE + r"^ACM Reference Format",
    "ccs_concepts": NO_CASE + r"^CCS Concepts",
    "keywords_heading": NO_CASE + r"^Keywords\b",
    "abstract_heading": NO_CASE + r"^Abstract\b",
    "email": UNICODE + r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "affiliation": NO_CASE + r"Universit|CNRS|Department of",
}
FOOTNOTE_CALL = r"(?<!\d)([A-Za-z)\]'’.,;:!?])(\d{1,2})(?!\d)"
RECURRING, RECURRING_LENGTH = 3, 80


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def join_hyphenated(text: Column) -> Column:
    """A word parted by a hyphen at the end of a line is joined."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", "$1$2")


def drop_footnote_calls(text: Column) -> Column:
    """One or two digits after a letter or mark go, if no digit stands before the mark or after the digits."""
    return F.regexp_replace(text, UNICODE + FOOTNOTE_CALL, "$1")


def squeeze(text: Column) -> Column:
    """Blanks to one, three newlines or more to two, stripped, with a newline at the end."""
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"))


def digit_form(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"\d+", "N")


def drop_page_numbers(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("line").rlike(PAGE_NUMBER))


def _marked() -> Column:
    any_mark = F.lit(False)
    for pattern in FRONT_MATTER.values():
        any_mark = any_mark | F.col("line").rlike(pattern)
    return any_mark


def drop_front_matter(rows: DataFrame) -> DataFrame:
    """Front-matter lines before the first introduction heading go; without a heading, those of the whole text."""
    start = F.min(F.when(F.col("line").rlike(UNICODE + HEADING), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("start", start).filter((F.col("line_no") >= F.col("start")) | ~_marked()).drop("start")


def front_matter_hits(rows: DataFrame) -> DataFrame:
    """One row for each line of the whole text and mark that it has; the line is stripped."""
    tags = F.array(*(F.when(F.col("line").rlike(p), F.lit(t)) for t, p in FRONT_MATTER.items()))
    return rows.select("doc_id", "line_no", F.explode(F.array_compact(tags)).alias("tag"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("line"))


def drop_end_sections(rows: DataFrame) -> DataFrame:
    """All from the first heading of notes, footnotes, references or a bibliography on goes."""
    heading = F.lit(False)
    for pattern in NOTES_HEADINGS:
        heading = heading | F.col("line").rlike(NO_CASE + pattern)
    start = F.min(F.when(heading, F.col("line_no"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("start", start).filter("start is null or line_no < start").drop("start")


def recurring_lines(rows: DataFrame, least: int = RECURRING, longest: int = RECURRING_LENGTH) -> DataFrame:
    """Short lines that occur so often in a text, digits apart."""
    norm = rows.withColumn("norm", digit_form(F.col("line"))).filter((F.length("norm") > 0) & (F.length("norm") <= longest))
    return norm.groupBy("doc_id", "norm").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def drop_recurring_lines(rows: DataFrame, least: int = RECURRING, longest: int = RECURRING_LENGTH) -> DataFrame:
    norm = digit_form(F.col("line"))
    short = (F.length(norm) > 0) & (F.length(norm) <= longest)
    n = F.count("*").over(Window.partitionBy("doc_id", norm))
    return rows.withColumn("n", n).filter(~short | (F.col("n") < least)).drop("n")


def joined(rows: DataFrame) -> DataFrame:
    """Lines put together again, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("doc_id").agg(F.array_join(ordered["line"], "\n").alias("text"))


def clean(docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """All steps in order: hyphens, footnote calls, glued words (with a dictionary: word), front matter, end sections,
    page numbers, recurring lines, blanks."""
    text = drop_footnote_calls(join_hyphenated(normalize_newlines(F.col("text"))))
    docs = docs.select("doc_id", text.alias("text"))
    if dictionary is not None:
        docs = rewrite_glued_words(docs, dictionary)
    rows = lines(docs)
    for step in (drop_front_matter, drop_end_sections, drop_page_numbers, drop_recurring_lines):
        rows = step(rows)
    return joined(rows).select("doc_id", squeeze(F.col("text")).alias("text"))


GLUED = "^[A-Za-z]{8,}$"


def rewrite_glued_words(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Long words that are not in the dictionary, but are two of its words in a row, are parted by a blank in the texts.

    Only distinct long words meet the dictionary; each text gets its own splits as a map."""
    pieces = F.regexp_extract_all("text", F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    docs = docs.withColumn("pieces", pieces).withColumn("row", F.monotonically_increasing_id() if docs.isStreaming else F.xxhash64("doc_id", "text"))
    long = docs.select("row", F.explode(F.array_distinct(F.transform(F.filter("pieces", lambda p: p.rlike(GLUED)), F.lower))).alias("word")).distinct()
    splits = split_glued_words(long.select("word"), dictionary).select("word", F.length("left_part").alias("at"))
    maps = long.join(splits, "word").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("word", "at"))).alias("splits"))

    def parted(p: Column) -> Column:
        at = F.col("splits")[F.lower(p)]
        return F.when(p.rlike(GLUED) & at.isNotNull(), F.concat(p.substr(F.lit(1), at), F.lit(" "), p.substr(at + 1, F.length(p)))).otherwise(p)

    rewritten = F.when(F.col("splits").isNull(), F.col("text")).otherwise(F.array_join(F.transform("pieces", parted), ""))
    return docs.join(maps, "row", "left").withColumn("text", rewritten).drop("row", "pieces", "splits")


def split_glued_words(words: DataFrame, dictionary: DataFrame, shortest: int = 8) -> DataFrame:
    """Unknown long words with the first place from the third on where both parts are known words."""
    unknown = words.select("word").distinct().filter(F.length("word") >= shortest).join(dictionary, "word", "left_anti")
    at = unknown.select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 4)).alias("at"))
    parts = at.select("word", "at", F.expr("substring(word, 1, at)").alias("left_part"), F.expr("substring(word, at + 1)").alias("right_part"))
    known = parts.join(dictionary.withColumnRenamed("word", "left_part"), "left_part", "left_semi").join(dictionary.withColumnRenamed("word", "right_part"), "right_part", "left_semi")
    return known.groupBy("word").agg(F.min_by(F.struct("left_part", "right_part"), "at").alias("p")).select("word", "p.left_part", "p.right_part")


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags go, entities of the five special characters are read, blanks are squeezed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


# Rewrites of markdown to prose, in the order in which they apply. Of fenced blocks only the fences go.
MARKDOWN = (
    (r"(?m)^(```|~~~)[^\n]*\n", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\(([^)]*)\)", "$1"),
    (r"(?m)^[ \t]*\[[^\]]+\]:\s*\S+.*$", ""),
    (r"\[([^\]]*)\]\[[^\]]*\]", "$1"),
    (r"<[^>]+>", ""),
    (r"(?m)^#{1,6}[ \t]*", ""),
    (r"(?m)^>[ \t]?", ""),
    (r"(?m)^[ \t]*[-*+][ \t]+", ""),
    (r"(?m)^[ \t]*\d+[.)][ \t]+", ""),
    (r"(?m)^[ \t]*([-*_])[ \t]*(\1[ \t]*){2,}$", ""),
    (r"(\*\*\*|___)(.+?)\1", "$2"),
    (r"(\*\*|__)(.+?)\1", "$2"),
    (r"(?<!\w)(\*|_)(?!\1)(.+?)\1(?!\w)", "$2"),
    (r"~~(.+?)~~", "$1"),
    (r"`([^`]*)`", "$1"),
    (r"(?m)^[ \t]*\|?[ \t:|-]*-[ \t:|-]*\|?[ \t]*$", ""),
    (r"(?m)^[ \t]*\|", ""),
    (r"(?m)\|[ \t]*$", ""),
    (r"\|", " "),
    (r"\n{3,}", "\n\n"),
)


def markdown_to_prose(text: Column) -> Column:
    for pattern, result in MARKDOWN:
        text = F.regexp_replace(text, UNICODE + pattern, result)
    return F.concat(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\n"))
