"""Streaming counterparts of gap detection (an extension): sessions and windowed levels with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """Runs of events that no gap interrupts: key, start, end, n."""
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def levels(events: DataFrame, window: str = "1 day", slide: str = "1 day", late: str = "10 minutes", value: str = "value", at: str = "ts") -> DataFrame:
    """Root mean square of values in sliding windows."""
    found = events.withWatermark(at, late).groupBy(F.window(at, window, slide).alias("w")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), "rms", "n")
