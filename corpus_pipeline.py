"""A corpus pipeline of five stages over the table of documents.

Each stage takes what its predecessor kept, written as Parquet and read again, and its decisions take effect: language
identification and toxicity drop the documents they reject, the Jaccard join leaves one document of each group,
decontamination drops documents with benchmark passages, and the last stage packs what is left.

Edge cases: documents with null, empty or letterless text are of no recognised language and go in the first stage.
Rows without an id are judged like others; near duplicates of a document with an id go, and of a group without any id one
row stays. Repeated rows leave one. Very long texts are taken whole by every
stage. Columns of the table beyond those of documents are not carried on, so their names cannot clash. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, jaccard_join, langid, packing, toxicity
from lectern.llm.storage import stored
from lectern.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language's score below which no language is taken to be recognised.
LANGUAGE_LEAST = 0.15
#: Near duplicates: words of a shingle, and the least Jaccard similarity in percent.
SHINGLE, PERCENT = 5, 80


#: Rows that a Python worker gets at once; texts are long, so that the usual number would be tens of MB.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def bounded(stage):
    """The stage with the session's batches for Python bounded; the bound stays set, as the result is computed later."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
            spark.conf.set(BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that look like no language that was learned, go."""
    found = langid.identify(docs)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LANGUAGE_LEAST)).select(*COLUMNS)


@bounded
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity of 0.3 or more go."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("toxicity") < toxicity.CUT).select(*COLUMNS)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; of repeated rows of it, one.

    Rows whose id occurs once are decided by it. Where ids repeat, rows are told apart by the keys of their sets too, as
    rows of one id may be of different groups."""
    found = stored(jaccard_join.keyed_components(docs, n=SHINGLE, percent=PERCENT), "pipeline-groups")
    docs, nameless = docs.select(*COLUMNS).filter("doc_id is not null"), docs.select(*COLUMNS).filter("doc_id is null")
    repeated = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    gone = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
    few = gone.count() <= jaccard_join.BROADCAST_ROWS
    kept = _nameless(nameless, found) if not found.filter("doc_id is null").isEmpty() else None
    if repeated.isEmpty():
        docs = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
        return docs if kept is None else docs.unionByName(kept)
    nameless = kept
    single = docs.join(repeated, "doc_id", "left_anti")
    kept = single.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    least = found.filter("doc_id = component_id").join(repeated, "doc_id", "left_semi")
    least = least.groupBy("doc_id", "label").agg(F.min("key").alias("key")).select(F.col("doc_id").alias("id"), F.col("key").alias("least"))
    several = jaccard_join.with_keys(docs.join(repeated, "doc_id", "left_semi"), SHINGLE)
    several = several.join(least, (F.col("doc_id") == F.col("id")) & F.col("key").eqNullSafe(F.col("least")), "left_semi")
    kept = kept.unionByName(several.dropDuplicates(["doc_id", "key"]).select(*COLUMNS))
    return kept if nameless is None else kept.unionByName(nameless)


def _nameless(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows without an id one of each group in which no document has one; those without words all stay."""
    groups = found.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("id"), F.min("key").alias("key")).filter("id is null").select("key")
    keyed = jaccard_join.with_keys(rows, SHINGLE)
    return keyed.join(groups, "key", "left_semi").dropDuplicates(["key"]).unionByName(keyed.filter("key is null")).select(*COLUMNS)


@bounded
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


@bounded
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]

#: Trained models and tokenizers cannot be expressed in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
