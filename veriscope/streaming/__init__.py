"""Sufficient statistics and windows over streams, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_statistics(events: DataFrame, cluster: str, value: str) -> DataFrame:
    """n, sum and sum of squares by cluster; for update mode on a stream, or a batch. State is one row per cluster."""
    v = F.col(value)
    return events.groupBy(cluster).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def windowed_statistics(events: DataFrame, at: str, value: str, width: str = "1 hour", late: str = "2 hours", *keys: str) -> DataFrame:
    """n, mean and largest by time window; rows later than the watermark are left out, and windows beyond it are closed."""
    stream = events.withWatermark(at, late) if events.isStreaming else events
    return stream.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top")).select(F.col("w.start").alias("start"), *keys, "n", "mean", "top")
