"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import attribution, bitplanes, chat, decontam, fingerprints, jaccard_join, langid, ngram_lm, packing, toxicity
from lectern.llm.storage import shared_folder, stored
from lectern.session import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("toxicity") >= toxicity.CUT, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"), "toxic_in_language")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"))


def op7_bit_plane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "planes")
    manifest = bitplanes.write_ids(table(spark, sf_dir, "documents"), folder)
    return bitplanes.read_ids(stored(manifest, "planes-manifest"))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ngram_lm.score_documents(docs, ~ngram_lm.held_out(F.col("doc_id")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings of a chat template.
CONTROL_CONVERSATION = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprints, op2_toxicity, op3_benchmark_decontamination, op4_language_id, op5_best_fit_packing, op6_token_counts, op7_bit_plane_output, op8_ngram_lm, op9_ngram_jaccard_join, op10_chat_formatting]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_formatting": chat.ORACLE}
