"""Parquet tables and the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp as it is written, whatever the session's time zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + F.round(F.extract(F.lit("second"), ts) * 1_000_000).cast("long")


def seconds(ts: Column) -> Column:
    return epoch_micros(ts) / F.lit(1e6)


def winner_of(event_type: Column) -> Column:
    """Clicks and purchases are points of player_a, views and sign-ups of player_b, others are unknown."""
    return F.when(event_type.isin("click", "purchase"), "player_a").when(event_type.isin("view", "signup"), "player_b").otherwise("unknown")


def match_events(events: DataFrame) -> DataFrame:
    """match_id, seq, ts (seconds) and winner of every event; unknown winners included."""
    return events.select(F.col("user_id").alias("match_id"), F.col("event_id").alias("seq"), seconds(F.col("ts")).alias("ts"), winner_of(F.col("event_type")).alias("winner"))


def known_events(events: DataFrame) -> DataFrame:
    return match_events(events).where("winner <> 'unknown'")


def signal(events: DataFrame) -> DataFrame:
    """clip, idx (from 0), t (seconds) and v: one sampled signal for each user."""
    # Named before the window, so that steps by clip find its partitioning.
    rows = events.select(F.col("user_id").alias("clip"), "ts", "event_id", seconds(F.col("ts")).alias("t"), F.col("value").alias("v"))
    order = Window.partitionBy("clip").orderBy("ts", "event_id")
    return rows.select("clip", (F.row_number().over(order) - 1).cast("long").alias("idx"), "t", "v")
