"""Streams of events: an extension over the batch verbs, with event time, late rows and stateful aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(events: DataFrame, time: str, size: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows of event time; rows later than `late` are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), *keys)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, size: str, slide: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts in overlapping windows."""
    out = events.withWatermark(time, late).groupBy(F.window(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Runs of events with less than `gap` between them."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
