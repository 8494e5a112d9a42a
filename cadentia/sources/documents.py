"""JSON documents other than drafts: table boxes, motion events, exported match events, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.operators.rectangles import find_boxes
from cadentia.operators.score import STATES, exported
from cadentia.sources.stream import written


def write_boxes(boxes: DataFrame, path: str) -> None:
    """One JSON line for each clip with its box x, y, w, h."""
    boxes.select("clip", "x", "y", "w", "h").write.json(path)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """clip and box of JSON lines in any encoding of rectangles, at any depth; the box is null where there is none."""
    lines = written(spark, spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"), "box-lines")
    found = find_boxes(lines, F.col("value"), ["line"])
    return lines.select("line", F.get_json_object("value", "$.clip").alias("clip")).join(found, "line").select("clip", "box")


def motion_documents(events: DataFrame, meta: DataFrame) -> DataFrame:
    """clip and document: meta, roi and events {t, kind, value} in order of time, as JSON text.

    events: clip, t, kind and value; meta: clip, and structs meta and roi. A document is one row, as one file was: a
    clip's motion events, which a refractory time keeps apart.
    """
    listed = events.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "kind", "value"))).alias("events"))
    rows = meta.join(listed, "clip", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<t:double,kind:string,value:double>>")))
    return rows.select("clip", F.to_json(F.struct("meta", "roi", "events")).alias("document"))


def write_events(events: DataFrame, path: str) -> None:
    """Match events as JSON lines of match_id, timestamp and winner, sorted within each match."""
    exported(events).repartition("match_id").sortWithinPartitions("match_id", "place").select("match_id", "timestamp", "winner").write.json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Exported events as match_id, seq, ts and winner; ties of time keep the order of the lines within a file."""
    rows = spark.read.schema("match_id long, timestamp double, winner string").json(path)
    return rows.select("match_id", F.monotonically_increasing_id().alias("seq"), F.col("timestamp").alias("ts"), "winner")


def write_states(states: DataFrame, path: str) -> None:
    """Match states as JSON lines (see ``score.STATES``)."""
    states.write.option("ignoreNullFields", False).json(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATES).json(path)


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and document (VARIANT) of each file of JSON, whatever it holds; a file that is no JSON has a null document."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("document"))


def write_report(clips: DataFrame, overall: DataFrame, least_iou: float, path: str) -> None:
    """A report as two sets of JSON lines: ``aggregate`` is one line, ``clips`` has one for each clip, however many there are."""
    detection = F.struct(*[F.col(c) for c in ("tp", "fp", "fn")], *[F.col(f"micro_{c}").alias(c) for c in ("precision", "recall", "f1")])
    quality = F.struct(*[F.col(f"macro_{c}").alias(c) for c in ("mean_iou", "winner_accuracy", "review_rate")])
    overall.select(F.col("n_clips").alias("clips"), F.lit(least_iou).alias("iou_threshold"), detection.alias("micro_detection"), quality.alias("macro_quality")).write.json(f"{path}/aggregate")
    clips.write.json(f"{path}/clips")
