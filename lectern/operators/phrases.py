"""n-grams of tokens, and the phrases that recur."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.words import TOKEN


def grams(docs: DataFrame, sizes: range, text: str = "text") -> DataFrame:
    """doc_id, n, pos, gram: every run of n lower-cased tokens, joined by blanks."""
    words = docs.select("doc_id", F.expr(f"regexp_extract_all(lower({text}), \"({TOKEN})\", 1)").alias("w"))
    every = [f"transform(if(size(w) >= {n}, sequence(0, size(w) - {n}), cast(array() as array<int>)), i -> named_struct('n', {n}, 'pos', i, 'gram', array_join(slice(w, i + 1, {n}), ' ')))" for n in sizes]
    return words.select("doc_id", F.explode(F.expr(f"flatten(array({', '.join(every)}))")).alias("g")).select("doc_id", "g.n", "g.pos", "g.gram")


def recurring_grams(rows: DataFrame, sizes: range) -> DataFrame:
    """doc_id, run, n, place, gram: the n-grams within runs of words that may recur in their text, and few others.

    A gram recurs only if the shortest gram at its place does. Those are found by their hashes in the text's own row, so that
    only what may recur is dealt; equal grams have equal hashes, and counts are taken of the grams themselves. Where
    several rows have one doc_id, all of their grams are kept, as a gram may recur in another row.

    rows: doc_id, dealt by it, and runs, an array of arrays of words."""
    low, copies = min(sizes), F.count("*").over(Window.partitionBy("doc_id"))
    every = f"flatten(transform(runs, (w, r) -> transform(if(size(w) >= {low}, sequence(0, size(w) - {low}), cast(array() as array<int>)), i -> named_struct('h', xxhash64(slice(w, i + 1, {low})), 'r', r, 'i', i))))"
    again = "if(copies > 1, every, filter(every, (x, j) -> coalesce(get(every, j - 1).h = x.h, false) or coalesce(get(every, j + 1).h = x.h, false)))"
    found = rows.withColumn("copies", copies).withColumn("every", F.array_sort(F.expr(every))).select("doc_id", "runs", F.explode(F.expr(again)).alias("x"))
    found = found.select("doc_id", F.col("x.r").alias("run"), F.col("x.i").alias("place"), F.expr(f"slice(runs[x.r], x.i + 1, {max(sizes)})").alias("w"))
    grams_there = [f"if(size(w) >= {n}, named_struct('n', {n}, 'gram', array_join(slice(w, 1, {n}), ' ')), null)" for n in sizes]
    return found.select("doc_id", "run", "place", F.explode(F.expr(f"filter(array({', '.join(grams_there)}), g -> g is not null)")).alias("g")).select("doc_id", "run", "g.n", "place", "g.gram")


def recurring_counts(texts: DataFrame, sizes: range) -> DataFrame:
    """The same as ``gram_counts`` of ``grams`` for at least two, from texts that are dealt by doc_id."""
    rows = texts.select("doc_id", F.array(F.expr(f'regexp_extract_all(lower(text), "({TOKEN})", 1)')).alias("runs"))
    return gram_counts(recurring_grams(rows, sizes).withColumnRenamed("place", "pos"))


def gram_counts(rows: DataFrame, least: int = 2) -> DataFrame:
    return rows.groupBy("doc_id", "n", "gram").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos")).filter(F.col("cnt") >= least)


def maximal(counts: DataFrame, longest: int | None = None) -> DataFrame:
    """Grams that no longer kept gram contains. Containment is transitive, so one pass does for the greedy one: each
    counted gram is parted into the shorter ones in it, and of equal grams of a text the part, if there is one, tells that
    the counted one goes. That is a group and no join, so rows dealt by doc_id stay where they are.

    longest: the longest size of the grams, if it is known; else a job asks for it. Texts without an id meet no others."""
    longest = longest if longest is not None else counts.agg(F.max("n")).first()[0] or 0
    parts = []
    for m in range(1, longest):
        parts.append(f"flatten(transform(if(n > {m}, sequence(0, n - {m}), cast(array() as array<int>)), i -> array(array_join(slice(split(gram, ' '), i + 1, {m}), ' '))))")
    if not parts:
        return counts
    own = F.struct(*(c for c in counts.columns if c not in ("doc_id", "gram")))
    inside = F.when(F.col("doc_id").isNotNull(), F.array_distinct(F.expr(f"concat({', '.join(parts)})"))).otherwise(F.array().cast("array<string>"))
    rows = counts.select("doc_id", "gram", own.alias("own"), inside.alias("inside"))
    both = rows.select("doc_id", F.explode(F.concat(F.array(F.struct("gram", "own")), F.transform("inside", lambda g: F.struct(g.alias("gram"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"))))).alias("g"))
    kept = both.groupBy("doc_id", "g.gram").agg(F.max("g.own").alias("own"), F.bool_or(F.col("g.own").isNull()).alias("inside")).filter("own is not null and not inside")
    return kept.select("doc_id", "gram", "own.*").select(*counts.columns)


def top_phrases(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("cnt"), F.desc("n"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
