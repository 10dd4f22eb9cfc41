"""Streaming forms of counting and deduplication over an event stream with a timestamp `ts`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """(start, key, n, total) by tumbling, or with slide sliding, windows; works on batches and streams alike."""
    kind = events.schema["ts"].dataType.simpleString()
    if events.isStreaming:
        events = _watermarked(events, late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast(kind).alias("start"), key, "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without later copies of the same keys."""
    return _watermarked(events, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    # watermarks need a timestamp with a time zone
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
