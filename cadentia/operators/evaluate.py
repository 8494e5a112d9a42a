"""Predicted intervals against labelled ones: overlap join, one-to-one matching, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions.boxes import interval_iou
from cadentia.functions.scalars import review_bucket, safe_divide
from cadentia.sources.stream import written


def candidates(pred: DataFrame, gt: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Pairs of one clip whose overlap over hull is at least the threshold. Both sides have clip, seq, t_start and t_end.

    Above a threshold of 0 such intervals overlap, and neither is longer than the other's length over the
    threshold. A label stands in one bin, of its clip, the power of two of its length and its start in units of
    twice that; a prediction looks in the bins where labels that fit may stand, so each pair meets at most once.
    """
    p = pred.select("clip", F.col("seq").alias("pi"), F.col("t_start").alias("p0"), F.col("t_end").alias("p1"))
    g = gt.select(F.col("clip").alias("g_clip"), F.col("seq").alias("gi"), F.col("t_start").alias("g0"), F.col("t_end").alias("g1"))
    on = F.col("clip") == F.col("g_clip")
    if least_iou > 0:
        unit = lambda power: F.pow(F.lit(2.0), power + 1)
        power = lambda length, more: F.floor(F.log2(length) + more).cast("int")
        p, g = p.where("p1 > p0"), g.where("g1 > g0")
        g = g.withColumn("g_power", power(F.col("g1") - F.col("g0"), 0.0)).withColumn("g_bin", F.floor(F.col("g0") / unit(F.col("g_power"))))
        apart = abs(math.log2(least_iou)) + 1e-6
        p = p.withColumn("power", F.explode(F.sequence(power(F.col("p1") - F.col("p0"), -apart), power(F.col("p1") - F.col("p0"), apart))))
        p = p.withColumn("bin", F.explode(F.sequence(F.floor(F.col("p0") / unit(F.col("power"))) - 1, F.floor(F.col("p1") / unit(F.col("power"))))))
        on &= (F.col("power") == F.col("g_power")) & (F.col("bin") == F.col("g_bin")) & (F.col("p0") < F.col("g1")) & (F.col("g0") < F.col("p1"))
    iou = interval_iou(F.col("p0"), F.col("p1"), F.col("g0"), F.col("g1"))
    return p.join(g, on).withColumn("iou", iou).where(F.col("iou") >= least_iou).select("clip", "pi", "gi", "iou")


def matched(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one choice: highest overlap first, then by order of predictions and labels.

    Pairs that are the best of both their sides are chosen and their rivals dropped, over and over: what a
    scan in that order would choose. Each round is written, and holds only the rivals of one side together.
    """
    spark = pairs.sparkSession
    by_p, by_g = (Window.partitionBy("clip", side) for side in ("pi", "gi"))
    pairs = pairs.groupBy("clip", F.col("pi").cast("long").alias("pi"), F.col("gi").cast("long").alias("gi")).agg(F.max("iou").alias("iou"))
    left, chosen = pairs, None
    while True:
        best_p = F.row_number().over(by_p.orderBy(F.desc("iou"), "gi")) == 1
        best_g = F.row_number().over(by_g.orderBy(F.desc("iou"), "pi")) == 1
        judged = left.withColumn("best_p", best_p).withColumn("chosen", F.col("best_p") & best_g).withColumn("used", F.max("chosen").over(by_g))
        judged = judged.withColumn("used", F.col("used") | F.max("chosen").over(by_p))
        judged = written(spark, judged.where("chosen or not used").select("clip", "pi", "gi", "iou", "chosen"), "matched")
        found = judged.where("chosen").drop("chosen")
        chosen = found if chosen is None else chosen.unionByName(found)
        left = judged.where("not chosen").drop("chosen")
        if left.isEmpty():
            return chosen


def unmatched(rows: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Predictions (side 'pi') or labels ('gi') without a match."""
    used = matches.select(F.col("clip"), F.col(side).alias("seq"))
    return rows.join(used, ["clip", "seq"], "left_anti")


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": safe_divide(2 * precision * recall, precision + recall)}


def clip_metrics(pred: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """One row a clip of either side. Winner accuracy is over matches whose label is known; an unknown prediction counts as wrong."""
    p = pred.groupBy("clip").agg(F.count("*").alias("n_pred"), F.count_if(F.col("winner") == "unknown").alias("n_unknown"), F.count_if((F.col("winner") == "unknown") | (review_bucket(F.col("confidence")) != "auto")).alias("n_review"))
    g = gt.groupBy("clip").agg(F.count("*").alias("n_gt"))
    m = matches.join(pred.select("clip", F.col("seq").alias("pi"), F.col("winner").alias("pw")), ["clip", "pi"]).join(gt.select("clip", F.col("seq").alias("gi"), F.col("winner").alias("gw")), ["clip", "gi"])
    known = F.col("gw").isin("player_a", "player_b")
    m = m.groupBy("clip").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"), F.count_if(known).alias("n_known"), F.count_if(known & (F.col("pw") == F.col("gw"))).alias("n_right"))
    rows = p.join(g, "clip", "full").join(m, "clip", "left").na.fill(0)
    rows = rows.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    return rows.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn"))).withColumns(
        {"winner_accuracy": safe_divide(F.col("n_right"), F.col("n_known")), "unknown_rate": safe_divide(F.col("n_unknown"), F.col("n_pred")), "review_rate": safe_divide(F.col("n_review"), F.col("n_pred"))}
    )


def overall_metrics(clips: DataFrame) -> DataFrame:
    """One row: counts added up and their rates, and unweighted means over clips."""
    total = clips.agg(F.count("*").alias("n_clips"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "mean_iou", "winner_accuracy", "review_rate")])
    return total.withColumns({f"micro_{k}": v for k, v in _rates(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def as_of(lookups: DataFrame, states: DataFrame, key: str, at: str, ts: str, seq: str, values: list[str]) -> DataFrame:
    """Each lookup with the last state at or before its time; of equal times the one of the largest seq. Nulls before the first.

    One sort of both sides together, whatever their sizes: the latest state is carried along.
    """
    both = states.select(F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(seq).alias("_seq"), F.struct(*values).alias("_state"), F.lit(None).cast(lookups.select(F.struct(*lookups.columns).alias("s")).schema["s"].dataType).alias("_row"))
    asked = lookups.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast(both.schema["_state"].dataType).alias("_state"), F.struct(*lookups.columns).alias("_row"))
    order = Window.partitionBy(key).orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.unionByName(asked).withColumn("_last", F.last("_state", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])
