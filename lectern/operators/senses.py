"""Word senses from an inventory table, scored by the overlap of context and gloss, and decisions about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inventory(words: DataFrame, by: str) -> DataFrame:
    """An inventory made of a table of words: two senses for each, whose glosses are the next words of its group.

    words: word, the group's column, rank (from 1 in each group, without gaps)."""
    near = words.select(F.col("word").alias("gloss"), by, F.col("rank").alias("other"))
    sense = words.select("word", by, F.explode(F.array(F.lit(0), F.lit(1))).alias("sense_rank"), F.col("rank").alias("own")).withColumn("other", F.col("own") + F.col("sense_rank") + 1)
    return sense.join(near, [by, "other"]).select("word", "sense_rank", "gloss")


def scored(occurrences: DataFrame, senses: DataFrame, context: DataFrame) -> DataFrame:
    """Score of each sense of each occurrence: how often its gloss stands in the sentence, plus a little for rank.

    occurrences: doc_id, sent_id, pos, word; context: doc_id, sent_id, words."""
    rows = occurrences.join(senses, "word").join(context, ["doc_id", "sent_id"])
    hits = F.size(F.filter("words", lambda w: w == F.col("gloss")))
    return rows.select("doc_id", "sent_id", "pos", "word", "sense_rank", (hits - F.col("sense_rank") * 0.5).alias("score"))


def withheld(found: DataFrame) -> DataFrame:
    """A word one of whose occurrences is not of its default sense is withheld from automatic acceptance."""
    flag = F.bool_or(F.col("predicted") != 0).over(Window.partitionBy("doc_id", "word"))
    return found.withColumn("withheld", flag)


def resolved(flagged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flagged words with a reviewer's decision: keep the default, take the prediction, delete, or nothing said."""
    kind = F.coalesce("kind", F.lit("default"))
    sense = F.when(kind == "default", 0).when(kind == "predicted", F.col("predicted"))
    return flagged.join(decisions, ["word"], "left").withColumn("sense", sense).filter(kind != "delete").drop("kind")
