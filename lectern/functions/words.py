"""Tokens, words and sentences of texts, and fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and apostrophes make a token.
TOKEN = "[A-Za-z']+"

# Function words of the four languages of the tables, in natural order.
FUNCTION_WORDS = (
    "a about after all an and are as at be been but by can could did do for from had has have he her his how i if in into is it its "
    "me more my no not of on or our out she so some than that the their them then there these they this to up was we were what when "
    "which who will with would you your au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour "
    "que qui sa se ses son sur un une vous als auf das dem den der die ein eine er es im ist mit nicht sich sie und von wie zu con del "
    "el las los lo por para su sus una y"
).split()


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def is_function_word(token: Column) -> Column:
    return token.isin(*FUNCTION_WORDS)


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos (from 0), token, lower: one row for each token."""
    rows = docs.select("doc_id", F.posexplode(F.expr(f"regexp_extract_all({text}, \"({TOKEN})\", 1)")).alias("pos", "token"))
    return rows.withColumn("lower", F.lower("token"))


def word_array(text: Column) -> Column:
    """White-space words; none for blank text."""
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, " "))


def paragraph_chunks(text: Column, most: int = 120) -> Column:
    """Texts of paragraphs, which blank lines part, their words joined by blanks; longer ones are cut every ``most`` words."""
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), word_array)
    starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(most))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(paragraphs, lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, most), " "))))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def sentence_array(text: Column) -> Column:
    """Text cut after full stops, exclamation and question marks that white space follows; blank parts are dropped."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(parts, lambda s: F.trim(s) != "")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id (from 0), sentence."""
    return docs.select("doc_id", F.posexplode(sentence_array(F.col("text"))).alias("sent_id", "sentence"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


#: The same relations in DuckDB's SQL, to be put after WITH.
SQL = {
    "tokens": f"""tokens AS (SELECT doc_id, CAST(unnest(range(len(t))) AS INT) AS pos, unnest(t) AS token, lower(unnest(t)) AS lower
  FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN.replace("'", "''")}') AS t FROM documents))""",
    "sentences": r"""sentences AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS sent_id, unnest(s) AS sentence
  FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents))""",
    "lines": r"""lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] if n in SQL else n for n in names) + "\n"


def word_array_sql(text: str) -> str:
    squeezed = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"CASE WHEN {squeezed} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({squeezed}, ' ') END"
