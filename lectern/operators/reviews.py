"""Decisions of reviewers as tables: edits of clusters, choices of trials and pairs, corrected classes, merged clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def picked_places(raw: Column) -> Column:
    """A list of places from 1 as typed: numbers parted by commas or blanks; blank is none, ``all`` is [-1], and null is
    what cannot be read."""
    text = F.lower(F.trim(raw))
    numbers = F.transform(F.filter(F.split(text, r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("int"))
    return F.when(text == "", F.array().cast("array<int>")).when(text == "all", F.array(F.lit(-1))).when(text.rlike(r"^\d+([,\s]+\d+)*,?$"), numbers)


def removed_and_kept(items: Column, raw: Column) -> tuple[Column, Column]:
    """The items that a typed list names, and the others; unreadable lists give nulls."""
    places = picked_places(raw)
    named = lambda i: F.array_contains(places, i + 1) | F.array_contains(places, -1)
    return F.when(places.isNotNull(), F.filter(items, lambda x, i: named(i))), F.when(places.isNotNull(), F.filter(items, lambda x, i: ~named(i)))


def reviewed_clusters(clusters: DataFrame, edits: DataFrame) -> DataFrame:
    """Clusters as reviewers leave them: accepted as they are, modified (renamed, without some stems), or dropped.

    clusters: doc_id, cluster, stems; edits: doc_id, cluster, action, new_name, removed. A cluster that nobody
    looked at is accepted; one that has no stem left is dropped."""
    rows = clusters.join(edits, ["doc_id", "cluster"], "left")
    action = F.coalesce("action", F.lit("accept"))
    stems = F.when(action == "modify", F.array_except("stems", F.coalesce("removed", F.array().cast("array<string>")))).otherwise(F.col("stems"))
    name = F.when((action == "modify") & (F.coalesce("new_name", F.lit("")) != ""), F.col("new_name")).otherwise(F.col("cluster"))
    return rows.withColumns({"kept_stems": stems, "name": name}).filter((action != "drop") & (F.size("kept_stems") > 0)).select("doc_id", "name", F.col("kept_stems").alias("stems"))


def reclassified(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Classes after review: a decision on a span takes the place of its class. decisions: span_id, new_kind."""
    rows = spans.join(decisions, "span_id", "left")
    return rows.withColumn("kind", F.coalesce("new_kind", "kind")).withColumn("changed", F.col("new_kind").isNotNull()).drop("new_kind")


def merged_clusters(main: DataFrame, noise: DataFrame) -> DataFrame:
    """Main and recovered clusters together; a name that is taken gets " (2)", " (3)" and so on, main clusters first.

    Both: doc_id, cluster, stems."""
    rows = main.withColumn("side", F.lit(0)).unionByName(noise.withColumn("side", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("doc_id", "cluster").orderBy("side", F.array_join("stems", " ")))
    return rows.withColumn("n", n).select("doc_id", F.when(F.col("n") > 1, F.format_string("%s (%d)", "cluster", "n")).otherwise(F.col("cluster")).alias("cluster"), "stems")


def resplit_clusters(parents: DataFrame, parts: DataFrame) -> DataFrame:
    """Each parent is replaced by the parts that share stems with it if there are two or more, else it stays.

    Both: doc_id, cluster, stems. Parents and parts meet by their stems."""
    stems = lambda rows, name: rows.select("doc_id", F.col("cluster").alias(name), F.explode("stems").alias("stem"))
    met = stems(parents, "parent").join(stems(parts, "part"), ["doc_id", "stem"]).select("doc_id", "parent", "part").distinct()
    split = met.groupBy("doc_id", "parent").agg(F.count("*").alias("n")).filter("n >= 2").select("doc_id", "parent")
    new = met.join(split, ["doc_id", "parent"]).select("doc_id", F.col("part").alias("cluster")).distinct().join(parts, ["doc_id", "cluster"])
    old = parents.join(split.withColumnRenamed("parent", "cluster"), ["doc_id", "cluster"], "left_anti")
    return old.select("doc_id", "cluster", "stems").unionByName(new.select("doc_id", "cluster", "stems"))


def trial_decision(trials: DataFrame, soft: float = 0.15) -> DataFrame:
    """What becomes of each group's trials: the first sane one within 5 % of the target; else the nearest sane one if it is
    within ``soft``, else escalation. trials: group_id, trial, words, target, sane."""
    far = F.abs(F.col("words") - F.col("target")) / F.col("target")
    rows = trials.withColumn("far", far).withColumn("hit", F.col("sane") & (F.col("far") <= 0.05))
    order = Window.partitionBy("group_id").orderBy(F.desc("hit"), F.when(F.col("hit"), F.col("trial")), F.desc("sane"), "far", "trial")
    best = rows.withColumn("r", F.row_number().over(order)).filter("r = 1")
    outcome = F.when(F.col("hit"), "success").when(F.col("sane") & (F.col("far") <= soft), "soft_accept").when(F.col("sane"), "escalate").otherwise("sanity_failed")
    return best.select("group_id", "trial", "words", outcome.alias("outcome"))


def chosen_pairs(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """The pairs of each text that a typed list names; the first one where the list is empty, unreadable or names none.

    pairs: doc_id, rank and more; raw: doc_id, picked."""
    rows = pairs.join(raw, "doc_id", "left").withColumn("places", F.coalesce(picked_places(F.coalesce("picked", F.lit(""))), F.array().cast("array<int>")))
    named = rows.withColumn("named", F.array_contains("places", F.col("rank").cast("int")) | F.array_contains("places", -1))
    some = F.bool_or("named").over(Window.partitionBy("doc_id"))
    return named.withColumn("some", some).filter("named or (not some and rank = 1)").drop("picked", "places", "named", "some")


def word_window(text: Column, start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """Up to so many words on each side of text[start, end), places from 0, with "..." where words are cut off; straight
    quotes become blanks."""
    def words(part: Column) -> Column:
        return F.filter(F.split(F.replace(part, F.lit('"'), F.lit(" ")), r"\s+"), lambda w: w != "")

    before, after = words(F.substring(text, F.lit(1), start)), words(F.substring(text, end + 1, F.length(text)))
    left = F.when(F.size(before) > width, F.concat(F.lit("... "), F.array_join(F.slice(before, -width, width), " "))).otherwise(F.array_join(before, " "))
    right = F.when(F.size(after) > width, F.concat(F.array_join(F.slice(after, 1, width), " "), F.lit(" ..."))).otherwise(F.array_join(after, " "))
    return left, right


def marked_word(text: Column, word: Column, width: int) -> Column:
    """The first occurrence of a word (any case, at word borders) in quotes inside its window; the text as it is
    where the word does not occur."""
    pattern = F.concat(F.lit(r"(?i)\b\Q"), word, F.lit(r"\E\b"))
    start = F.regexp_instr(text, pattern) - 1
    found = F.substring(text, start + 1, F.length(word))
    left, right = word_window(text, start, start + F.length(word), width)
    return F.when(start >= 0, F.trim(F.concat(left, F.lit(' "'), found, F.lit('" '), right))).otherwise(text)


def words_a_side(gloss_words: Column, most: int = 128, marks: int = 1) -> Column:
    """Words of context on each side that fit a budget of tokens beside a gloss and the marks; one at least."""
    budget = F.greatest(F.lit(most - 3 - 2 * marks) - gloss_words, F.lit(2 * marks))
    return F.greatest(F.lit(1), F.floor(budget / F.lit(marks) / F.lit(1.6) / F.lit(2)).cast("int"))


def plain_stem(term: Column) -> Column:
    """A stem as it is compared: without stars at its end, in lower case."""
    return F.lower(F.regexp_replace(term, r"\*+$", ""))


def highlighted(words: Column, marked: Column) -> Column:
    """Words joined by blanks, those that are marked between four stars on each side."""
    return F.array_join(F.zip_with(words, marked, lambda w, m: F.when(m, F.concat(F.lit("****"), w, F.lit("****"))).otherwise(w)), " ")


def fitted_contexts(lengths: Column, budget: int, least: int = 3) -> Column:
    """How many words of each context may stay when they share a budget: each gets an equal part of what is left, ``least``
    at least, and what it does not need goes to those after it."""
    zero = F.struct(F.lit(budget).cast("double").alias("left"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("given"))

    def step(a: Column, n: Column) -> Column:
        part = F.greatest(F.floor(a["left"] / (F.size(lengths) - a["i"])), F.lit(least)).cast("int")
        mine = F.least(n, part)
        return F.struct(F.greatest(a["left"] - mine, F.lit(0.0)).alias("left"), (a["i"] + 1).alias("i"), F.concat(a["given"], F.array(mine)).alias("given"))

    return F.aggregate(lengths, zero, step, lambda a: a["given"])


def resumable(files: DataFrame, phases: dict[str, list[str]]) -> DataFrame:
    """Which phases of each corpus have all their files. files: corpus, file."""
    there = files.groupBy("corpus").agg(F.collect_set("file").alias("files"))
    ready = {phase: F.forall(F.array(*(F.lit(n) for n in needed)), lambda n: F.array_contains("files", n)) for phase, needed in phases.items()}
    return there.select("corpus", *(c.alias(phase) for phase, c in ready.items()))


def retrieved(scored: DataFrame, most: int, lead: int) -> DataFrame:
    """doc_id, chunks: the best ``most`` chunks of each text and its first ``lead`` ones, in the text's order.

    scored: doc_id, chunk (from 0), score."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk")
    kept = scored.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= most) | (F.col("chunk") < lead))
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))


def shown(items: Column, most: int) -> Column:
    """The first items and how many more there are."""
    more = F.when(F.size(items) > most, F.concat(F.lit(" and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), more)
