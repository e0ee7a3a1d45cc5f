"""Streaming forms of the activity log: hourly counts, sessions, deduplication; claims are in `claims`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and kind; works on streams (late rows up to `late` count) and on tables."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "3 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "40 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user; a gap of exactly the length begins a new one."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")


def first_of_each(events: DataFrame, key: str = "content_hash", within: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the time before; on tables, the first of each key."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])
    from lightshelf.operators.ranking import latest_per_key

    return latest_per_key(events, [key], [F.col("ts"), F.col("event_id")])
