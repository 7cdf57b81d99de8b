"""Readers and writers of texts, states, logs and tables, all through Spark's file sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_KINDS = ("txt", "md", "markdown", "pdf")
STATE = "excludedNgrams array<string>, clusterDefs array<struct<name string, stems array<string>, ngrams array<string>, excluded_stems array<string>, excluded_ngrams array<string>, reembedded_stems array<string>, reembedded_source string>>"
DECISION = "timestamp timestamp, corpus string, phase string, step string, decision_type string, prompt string, options string, choice string, extra string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share; below /tmp only where that is unset and the session
    runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    base = base or "/tmp/lectern-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def joined_pages(pages: Column) -> Column:
    """Texts of pages, stripped, joined by blank lines; null if there is no text at all."""
    filled = F.filter(F.transform(pages, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.size(filled) > 0, F.array_join(filled, "\n\n"))


def read_texts(spark: SparkSession, path: str, pdf_pages: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, kind, text of files of the kinds known; others are an error. Line ends become newlines.

    ``pdf_pages`` makes an array of the pages' texts from the bytes of a PDF. Without it, PDFs are an error, as are
    those without any text."""
    raw = spark.read.format("binaryFile").load(path)
    kind = extension(F.col("path"))
    error = lambda what: F.raise_error(F.concat(F.lit(what), "path"))
    pdf = F.coalesce(joined_pages(pdf_pages(F.col("content"))), error("no text in ")) if pdf_pages else error("no reader of PDF is given for ")
    text = F.when(kind.isin("txt", "md", "markdown"), F.decode("content", "UTF-8")).when(kind == "pdf", pdf).otherwise(error("unknown kind of file: "))
    return raw.select("path", kind.alias("kind"), F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("text"))


def read_condensed(spark: SparkSession, path: str) -> DataFrame:
    """corpus, rate, text of all condensed texts below a folder, whole files."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    names = raw.select("value", F.regexp_extract("path", r"([^/]+)-condensed-(\d+)pct\.txt$", 1).alias("corpus"), F.regexp_extract("path", r"-condensed-(\d+)pct\.txt$", 1).alias("rate"))
    return names.filter("rate <> ''").select("corpus", F.col("rate").cast("int").alias("rate"), F.col("value").alias("text"))


def config_rows(spark: SparkSession, corpus: str, phase: str, settings: dict) -> DataFrame:
    """One record of the decision log for each setting."""
    rows = [(corpus, phase, "setup", name, str(value)) for name, value in sorted(settings.items())]
    return spark.createDataFrame(rows, "corpus string, phase string, step string, decision_type string, choice string")


def environment(spark: SparkSession) -> DataFrame:
    """One row about the session that made a result."""
    return spark.range(1).select(F.version().alias("spark_version"), F.lit(spark.sparkContext.master).alias("master"), F.lit(spark.conf.get("spark.sql.shuffle.partitions")).alias("shuffle_partitions"), F.current_timezone().alias("time_zone"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).option("multiLine", True).json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISION).json(path)


def append_decisions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest(decisions: DataFrame) -> DataFrame:
    """The last choice of each corpus, phase and type of decision."""
    return decisions.groupBy("corpus", "phase", "decision_type").agg(F.max_by("choice", "timestamp").alias("choice"), F.count("*").alias("n"))


def rates(paths: DataFrame) -> DataFrame:
    """Condensation rates by corpus from names of files."""
    found = paths.select(F.regexp_extract("path", r"([^/]+)/[^/]*-condensed-(\d+)pct\.txt$", 1).alias("corpus"), F.regexp_extract("path", r"-condensed-(\d+)pct\.txt$", 1).alias("rate"))
    return found.filter("rate <> ''").select("corpus", F.col("rate").cast("int").alias("rate"))
