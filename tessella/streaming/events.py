"""Structured Streaming forms of mergeable operators: an addition beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_sums(events: DataFrame, size: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Count and sum of each type and tumbling window; with a watermark, state is bounded."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Sessions of each user."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_bins(scores: DataFrame) -> DataFrame:
    """Mergeable sums of a bin, for update mode."""
    x = F.col("score").cast("double")
    return scores.groupBy("topic", "format").agg(F.sum(x).alias("total"), F.sum(F.abs(x)).alias("abs_total"), F.sum(x * x).alias("square_total"), F.count("*").alias("doc_count"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
