"""Counts in windows of event time and sessions with Structured Streaming; `delta_log` keeps an upserted table.

These are extensions: the batch operators give the same results from whole tables.

Defined results: rows later than the watermark allows are dropped; a null kind or key is one like others; rows without a time belong to no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind in tumbling windows of event time; rows later than `late` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events that follow each other within `gap`."""
    found = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
