"""Structured Streaming over the memory event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """The event log as a stream of Parquet files."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("kind"), "value", F.col("ts").cast("timestamp").alias("occurred_at"))


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each sequence once within the watermark: idempotent appends."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["sequence"])


def windows(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, kind, n, total per tumbling or sliding window."""
    e = events.withWatermark("occurred_at", late) if late else events
    w = F.window("occurred_at", size, slide) if slide else F.window("occurred_at", size)
    return e.groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """subject, start, n per session."""
    e = events.withWatermark("occurred_at", late) if late else events
    return e.groupBy(F.session_window("occurred_at", gap).alias("w"), "subject").agg(F.count(F.lit(1)).alias("n")).select("subject", F.col("w.start").alias("start"), "n")


def triggers(events: DataFrame, every: int) -> DataFrame:
    """subject, fired: how many times a subject's events reached the threshold count."""
    return events.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).select("subject", F.floor(F.col("n") / every).cast("long").alias("fired")).filter("fired > 0")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all available input into a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
