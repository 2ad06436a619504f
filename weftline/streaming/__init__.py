"""Event-time helpers, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, length: str, keys: list[str], aggs: list[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates a time window and key; ``late``: how long a stream waits for late rows, whose state it then drops."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(span.alias("_span"), *keys).agg(*aggs).select(F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), *keys, *[F.col(f"`{n}`") for n in _names(df, keys, aggs)])


def _names(df: DataFrame, keys: list[str], aggs: list[Column]) -> list[str]:
    return df.limit(0).groupBy(*keys).agg(*aggs).columns[len(keys) :]


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates a session: rows of a key with no gap as long as ``gap`` between them."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    return rows.groupBy(F.session_window(time, gap).alias("_span"), *keys).agg(*aggs).select(F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), *keys, *[F.col(f"`{n}`") for n in _names(df, keys, aggs)])
