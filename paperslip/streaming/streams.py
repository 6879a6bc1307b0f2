"""Streams: extraction, knowledge-base refresh and metrics over micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperslip.operators.knowledge import upsert_kb


def stream_extract(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that writes what a batch operator gives for the documents of each micro-batch, whose lines are there together (`assemble_documents`).

    A batch that is run again replaces its own folder, so that results are exact after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert_kb(stream: DataFrame, base: str, checkpoint: str):
    """Start a query that adds each micro-batch to the table at `base`, as v=n beside the rows of v=0; `latest` reads what holds by id and version.

    A batch writes its own rows only, whatever the size of the table; running a batch again gives the same rows.
    """
    columns = stream.sparkSession.read.parquet(f"{base}/v=0").columns

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(columns)
        upsert_kb(rows, rows.where("false")).write.mode("overwrite").parquet(f"{base}/v={number + 1}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_metrics(results: DataFrame, size: str = "1 hour", watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, n_review, total): requests, those for review and the sum of values per window; works on streams and tables."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    per = results.withWatermark("ts", watermark).groupBy(window.alias("w"), "event_type")
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 20).alias("n_review"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "n_review", "total")


def latest(spark: SparkSession, base: str) -> DataFrame:
    """The rows that hold among all that have been added below `base`: of one id the highest version."""
    every = spark.read.option("basePath", base).parquet(base).drop("v")
    return upsert_kb(every, every.where("false"))


def compact(spark: SparkSession, base: str, to: str) -> None:
    """Write the rows that hold as v=0 of a new table, so that reading it need not look at what has been replaced."""
    latest(spark, base).write.parquet(f"{to}/v=0")
