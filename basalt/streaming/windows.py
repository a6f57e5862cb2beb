"""Windowed aggregation of event streams with late data, on Structured Streaming.

The same functions take batch DataFrames, which is how tests hold streams against plain queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, delay: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone: one without is taken in the session's."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], *aggregates, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates per key and window of `size`, sliding by `slide` if given; rows later than `delay` are left out of streams."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = _late(df, time, delay).groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates, delay: str = "10 minutes") -> DataFrame:
    """Aggregates per key and session: events no further apart than `gap`."""
    out = _late(df, time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])
