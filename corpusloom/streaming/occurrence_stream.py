"""The same expressions over streams: per-record work needs no state, windowed counts take a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts by window and key of a stream or a table; rows later than the lateness are dropped from a stream."""
    # A watermark needs a time with a zone.
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n")
