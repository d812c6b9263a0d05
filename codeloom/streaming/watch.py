"""Streaming upkeep: debounced change batches and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def watch(
    spark: SparkSession, path: str, schema: StructType, apply: Callable[[DataFrame, int], None], checkpoint: str, debounce_ms: int = 500,
    once: bool = False,
) -> StreamingQuery:
    """Applies each batch of change events as a set. A batch holds what came in over at least 50 ms; the checkpoint makes batches repeatable."""
    stream = spark.readStream.schema(schema).parquet(path)
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{max(debounce_ms, 50)} milliseconds")
    return w.start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total over event-time windows; works on a stream or a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, n: runs of a user's events with no gap of that length."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), "n")


def incremental_counts(spark: SparkSession, path: str, schema: StructType, checkpoint: str, state: str) -> DataFrame:
    """Counts by event type kept by a stream: each batch adds its own sums to a table, keyed by batch id so that a repeated batch counts once."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    watch(spark, path, schema, add, checkpoint, once=True).awaitTermination()
    sums = spark.read.schema("event_type string, n long, total double").parquet(f"{state}/batch=*")
    return sums.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
