"""Event-time windows, an extension: the dialect has no streams. Each takes batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, *keys: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    out = _late(df, ts, late).groupBy(F.window(ts, size).alias("_w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)


def sliding(df: DataFrame, ts: str, size: str, slide: str, *keys: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    out = _late(df, ts, late).groupBy(F.window(ts, size, slide).alias("_w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, *keys: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    out = _late(df, ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)
