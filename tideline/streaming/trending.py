"""Windowed popularity over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, ts: str = "ts", item: str = "item", window: str = "1 day", late: str = "6 hours") -> DataFrame:
    """(start, item, n): clicks per item and tumbling window; works on a stream or a table. Rows later than ``late`` are dropped on a stream."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, window).alias("w"), item).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), item, "n")
