"""Continuous ingest: running counts of records and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder or glob as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(
    stream: DataFrame, ts: str, category: str, window: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """Records per event-time window and category; state is dropped once ``late`` has passed."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), F.col(category).alias("category"))
        .agg(F.count(F.lit(1)).alias("records"))
        .select(F.col("w.start").alias("window_start"), "category", "records")
    )


def ingest_counts(
    stream: DataFrame, keys: dict[str, Column], table: str, checkpoint: str
) -> StreamingQuery:
    """Count what has arrived per key and add it to a Parquet table, then stop.

    Every micro-batch writes its own ``batch`` partition by overwriting, so a batch run again after
    a failure counts once. Late records count in full; nothing is kept as state.
    """

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
            F.count(F.lit(1)).alias("records")
        )
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def closed_windows(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Add the windows of ``windowed_counts`` that the watermark has closed to a Parquet table, then stop.

    Counts of open windows stay in the state below ``checkpoint``; the next run goes on with them.
    """
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Totals over all batches ingested so far."""
    return (
        spark.read.parquet(table).groupBy(*keys).agg(F.sum("records").alias("records"))
    )
