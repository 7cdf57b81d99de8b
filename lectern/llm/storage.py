"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Of Spark: whether a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, as a URI.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only where that is unset and the session runs on
    one machine, as in tests, a folder below /tmp is used; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        base = "file:///tmp/lectern-checkpoints"
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Of Spark: rows that a Python worker gets at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read from it: lineage ends here and survives lost executors.

    The write's own shuffle files are deleted when it has ended; ``drop_folder`` deletes the table. ``batch`` bounds the rows
    that a Python worker gets at once in this write, if the session's own bound is larger.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, name), {k: spark.conf.get(k) for k in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    if batch and not 0 < int(before[BATCH]) <= batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_folder(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        path = getattr(df, "stored_at", None) if "stored_at" not in df.columns else None
        if path:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
