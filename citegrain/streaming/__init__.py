"""Counts over time as Structured Streaming queries; an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n of each tumbling window; late rows count until the watermark has passed. stream: ts, event_type."""
    return _timed(stream).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of each session: events of a user with less than the gap between them."""
    return _timed(stream).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
