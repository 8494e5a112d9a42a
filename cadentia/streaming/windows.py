"""Counts of a stream by windows of event time, given out once the watermark has passed a window's end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counted(events: DataFrame, span, key: str) -> DataFrame:
    n = lambda w: F.count_if(F.col("winner") == w)
    counts = events.groupBy(span.alias("span"), key).agg(F.count("*").alias("n"), n("player_a").alias("wins_a"), n("player_b").alias("wins_b"))
    return counts.select(F.unix_micros("span.start").alias("from_us"), F.unix_micros("span.end").alias("to_us"), key, "n", "wins_a", "wins_b")


def window_counts(events: DataFrame, key: str, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """from_us, to_us, key, n, wins_a and wins_b of each window of ``length``, one every ``slide`` (or one after the other), with events.

    events: key, at (TIMESTAMP) and winner. Partial counts are made before the shuffle, so a key that most events share is no single task's work.
    """
    return _counted(events.withWatermark("at", delay), F.window("at", length, slide) if slide else F.window("at", length), key)


def session_counts(events: DataFrame, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """The same of each session: events of a key that follow each other within less than ``gap``; it ends that long after its last one."""
    return _counted(events.withWatermark("at", delay), F.session_window("at", gap), key)
