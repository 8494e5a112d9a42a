"""Draft-match JSON documents: reading with a permissive schema, strict and semantic checks, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.functions.scalars import shown_float

# Changes of fields are of any type; each is a value of its own.
CORRECTIONS = "array<struct<at:string,by:string,changes:map<string,variant>,note:string>>"
DRAFT_SCHEMA = f"""
schema_version string, sport string, video_path string, video_fps double, best_of int, created_at string,
roi struct<x:string,y:string,w:string,h:string>,
points array<struct<id:string,t_start:double,t_end:double,winner:string,confidence:double,flags:array<string>,source:string,
  corrections:{CORRECTIONS}>>,
score_validation string"""


def read_drafts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each JSON file, with its path."""
    return spark.read.option("multiLine", True).schema(DRAFT_SCHEMA).json(path).withColumn("path", F.col("_metadata.file_path"))


def _integer(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^-?\d+$"), F.lit(False))


def strict_errors(d: DataFrame) -> DataFrame:
    """The rows with ``strict_errors``: mandatory fields that are missing, and boxes or points without theirs."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"Mandatory field '{c}' is missing or null.")) for c in ("schema_version", "video_path", "video_fps", "roi")]
    boxes = [F.when(F.col("roi").isNotNull() & ~_integer(F.col(f"roi.{k}")), F.lit(f"ROI field '{k}' is missing or not an integer.")) for k in "xywh"]
    incomplete = F.exists(F.coalesce("points", F.array()), lambda p: p["id"].isNull() | p["t_start"].isNull() | p["t_end"].isNull())
    return d.withColumn("strict_errors", F.array_compact(F.array(*missing, *boxes, F.when(incomplete, "A point lacks id, t_start or t_end."))))


def document_errors(d: DataFrame) -> DataFrame:
    """path and message: what is wrong with a document as such, apart from its points."""
    # The texts of errors.
    width = F.coalesce(F.when(_integer(F.col("roi.w")), F.col("roi.w")).cast("int"), F.lit(0))
    wrong = [F.when(width <= 0, "ROI is missing or has zero width"), F.when(F.coalesce(F.col("video_fps"), F.lit(0.0)) <= 0, "Invalid video_fps")]
    return d.select("path", F.explode(F.array_compact(F.array(*wrong))).alias("message"))


def draft_points(d: DataFrame) -> DataFrame:
    """One row a point with its ordinal and the defaults of optional fields. Documents without points give none."""
    rows = d.select("path", F.coalesce("best_of", F.lit(5)).alias("best_of"), F.posexplode("points").alias("seq", "p"))
    return rows.select(
        "path", "best_of", "seq", "p.id", "p.t_start", "p.t_end", F.coalesce("p.winner", F.lit("unknown")).alias("winner"), F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("p.flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("p.source", F.lit("ai")).alias("source"), "p.corrections",
    )


def changed_fields(points: DataFrame, key: str = "path") -> DataFrame:
    """One row for each field that a correction of a point changes: key, seq, place (of the correction, from 0), at, by and note, empty where they are missing, field and value (variant)."""
    rows = points.select(key, "seq", F.posexplode("corrections").alias("place", "c"))
    text = lambda k: F.coalesce(f"c.{k}", F.lit("")).alias(k)
    return rows.select(key, "seq", "place", text("at"), text("by"), text("note"), F.explode("c.changes").alias("field", "value"))


def point_errors(points: DataFrame, key: str = "path") -> DataFrame:
    """key, seq and message: bad time ranges, and starts before the previous point's start."""
    # The texts of errors.
    before = F.coalesce(F.lag("t_start").over(Window.partitionBy(key).orderBy("seq")), F.lit(-1.0))
    shown = F.concat(F.lit("Point "), F.col("seq").cast("string"), F.lit(": "))
    bad_range = F.when((F.col("t_start") < 0) | (F.col("t_end") <= F.col("t_start")), F.concat(shown, F.lit("Invalid time range ("), shown_float(F.col("t_start")), F.lit(" -> "), shown_float(F.col("t_end")), F.lit(")")))
    disorder = F.when(F.col("t_start") < before, F.concat(shown, F.lit("Non-monotonic timestamps (start before previous end)")))
    found = points.withColumn("messages", F.array_compact(F.array(bad_range, disorder)))
    return found.select(key, "seq", F.explode("messages").alias("message"))


def score_events(points: DataFrame, key: str = "path", use_end: bool = True) -> DataFrame:
    """Known winners as match events at the end (or start) of their point."""
    return points.where("winner <> 'unknown'").select(F.col(key).alias("match_id"), F.col("seq").cast("long").alias("seq"), F.col("t_end" if use_end else "t_start").alias("ts"), "winner")


def write_drafts(d: DataFrame, path: str) -> None:
    """Write documents (with their path) as JSON lines; refuses if any has strict errors, or errors of its values or points."""
    if (bad := strict_errors(d).where(F.size("strict_errors") > 0).select("strict_errors").first()) is not None:
        raise ValueError("; ".join(bad[0]))
    found = document_errors(d).select("message").union(point_errors(draft_points(d)).select("message")).limit(10).collect()
    if found:
        raise ValueError("; ".join(r["message"] for r in found))
    d.drop("path").write.json(path)


def _place(path: Column) -> Column:
    """A file's URI as Spark tells it, in the form in which Hadoop writes paths: decoded, without an empty authority."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^file:/+", "file:/")


def _qualified(spark: SparkSession, name: str) -> str:
    """A path as a manifest has it, relative to the working folder of its file system where it is relative."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def manifest_sides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and labelled points of all pairs of a manifest, with the pair's name as clip: sides for ``evaluate``.

    Files are named absolutely or relative to the working folder, on any file system. A file that is missing or has strict errors is an error.
    """
    pairs = read_manifest(spark, path)
    names = [r[0] for r in pairs.select("pred").union(pairs.select("gt")).distinct().collect()]  # as many as the manifest names
    named = [(n, _qualified(spark, n)) for n in names]
    places = spark.createDataFrame(named, "name string, place string")
    documents = read_drafts(spark, sorted({place for _, place in named})).withColumn("path", _place(F.col("path")))
    if (bad := strict_errors(documents).where(F.size("strict_errors") > 0).select("path", "strict_errors").first()) is not None:
        raise ValueError(f"{bad[0]}: " + "; ".join(bad[1]))
    points = draft_points(documents).select(F.col("path").alias("place"), F.col("seq").cast("long").alias("seq"), "t_start", "t_end", "winner", "confidence")

    def side(c: str) -> DataFrame:
        clips = pairs.select(F.col("name").alias("clip"), F.col(c).alias("name")).join(F.broadcast(places), "name")
        return points.join(clips.select("clip", "place"), "place").drop("place")

    return side("pred"), side("gt")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, pred and gt of each pair; the name defaults to the stem of pred. A document without pairs is one pair."""
    pair = "struct<name:string,pred:string,gt:string>"
    d = spark.read.option("multiLine", True).schema(f"pairs array<{pair}>, name string, pred string, gt string").json(path)
    p = d.select(F.explode(F.coalesce("pairs", F.array(F.struct("name", "pred", "gt")))).alias("p")).select("p.*")
    return p.select(F.coalesce("name", F.regexp_extract("pred", r"([^/\\]+?)(\.[^./\\]*)?$", 1)).alias("name"), "pred", "gt")
