"""Incremental reading of an append-only log: the last choice of each key as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_choices(spark: SparkSession, folder: str, schema, keys: list[str], choice: str, order: list[str], out: str, checkpoint: str) -> DataFrame:
    """Run over all files there are, then stop; state is kept at the checkpoint, so the next run takes new files only.

    The whole result is written anew for each batch, under its number, so a batch that runs twice writes the same."""
    stream = spark.readStream.schema(schema).parquet(folder)
    last = stream.groupBy(*keys).agg(F.max_by(choice, F.struct(*order)).alias("choice"), F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    job = last.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    batches = spark.read.parquet(out)
    newest = batches.agg(F.max("batch")).first()[0]
    return batches.filter(F.col("batch") == newest).drop("batch")
