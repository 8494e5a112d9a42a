"""Consensus of candidate boxes over frames: the candidate that ranks highest against the median box."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions.boxes import aspect_prior, box_iou, centre_prior, recovery_rank


def ranked_boxes(boxes: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    """Boxes (clip, seq, x, y, w, h, score) with the overlap with their clip's median box and a rank of four equal parts."""
    clip = Window.partitionBy("clip")
    rows = boxes.withColumns({f"m{c}": F.median(c).over(clip).cast("int") for c in "xywh"})
    rows = rows.withColumn("iou", box_iou(*(F.col(c) for c in "xywh"), *(F.col(f"m{c}") for c in "xywh")))
    parts = [F.col("iou"), centre_prior(*(F.col(c) for c in "xywh"), frame_w, frame_h), F.col("score"), aspect_prior(F.col("w"), F.col("h"))]
    return rows.withColumn("rank", sum((p * 0.25 for p in parts[1:]), parts[0] * 0.25))


def consensus_boxes(boxes: DataFrame, frame_w: int, frame_h: int, expand_top: float = 0.02) -> DataFrame:
    """The best box of each clip, the first of equals, with its top moved up by a share of its height."""
    best = ranked_boxes(boxes, frame_w, frame_h).withColumn("place", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("rank"), "seq"))).where("place = 1")
    up = F.greatest(F.lit(0), F.col("y") - F.bround(F.col("h") * expand_top).cast("int"))
    best = best.withColumn("top", up)
    return best.select("clip", "seq", "x", F.col("top").alias("y"), "w", F.least(F.lit(frame_h) - F.col("top"), F.col("h") + F.col("y") - F.col("top")).alias("h"))


# Fixed values of the rule for boxes that a detector cut off at a side.
LEAST_ASPECT, LEAST_WIDER, LEAST_BETTER_SHAPE, MOST_WORSE_SCORE, CLEARLY = 2.95, 0.20, 0.08, 0.04, 1.10
EDGE_PIXELS, EDGE_SHARE = 6, 0.02
#: Ranks nearer than this differ at most by rounding.
SAME_RANK = 1e-12


def sides_to_repair(x: Column, w: Column, h: Column, dx: Column, dw: Column, left_score: Column, right_score: Column) -> tuple[Column, Column]:
    """Whether the left and the right side of a refined box look cut off: the box is too narrow for a table and ends where the detector's box does.

    Where it ends at both sides, the one with the clearly stronger continuation counts, or both if neither is.
    """
    slack = F.greatest(F.lit(EDGE_PIXELS), (dw * EDGE_SHARE).cast("int"))
    at_left, at_right = F.abs(x - dx) <= slack, F.abs((x + w) - (dx + dw)) <= slack
    narrow = w / F.greatest(F.lit(1.0), h.cast("double")) < LEAST_ASPECT
    more_left, more_right = left_score > right_score * CLEARLY, right_score > left_score * CLEARLY
    return narrow & at_left & (~at_right | more_left | ~more_right), narrow & at_right & (~at_left | ~more_left)


def recovered(detections: DataFrame, repairs: DataFrame, frame_w: int, frame_h: int, cx: float = 0.5, cy: float = 0.55) -> DataFrame:
    """clip, seq, x, y, w, h, score and side of each detection: the refined box, or the one of a repaired side that replaces it.

    detections: clip, seq, the refined box x, y, w, h and its score, the detector's dx and dw, and how well the table goes on at
    either side, left_score and right_score. repairs: clip, seq, side (left or right), x, y, w, h and score of boxes refined in a search that
    reaches farther to a side. A repair counts if its side is to be repaired, it is wider and better in shape, and its score is not much
    worse; of those that rank above the refined box the first in rank is taken, the left one if ranks are equal. Detections without
    such a repair stay as they are, with a null side.
    """
    rank = lambda x, y, w, h, score: recovery_rank(aspect_prior(w, h), score, centre_prior(x, y, w, h, frame_w, frame_h, cx, cy))
    aspect = lambda w, h: w / F.greatest(F.lit(1.0), h.cast("double"))
    own = [F.col(c) for c in ("x", "y", "w", "h", "score")]
    left, right = sides_to_repair(F.col("x"), F.col("w"), F.col("h"), F.col("dx"), F.col("dw"), F.col("left_score"), F.col("right_score"))
    rows = detections.select("clip", "seq", *own, left.alias("left"), right.alias("right"), rank(*own).alias("own_rank"))
    offered = repairs.select("clip", "seq", "side", *[c.alias(f"r_{n}") for c, n in zip(own, ("x", "y", "w", "h", "score"), strict=True)])
    r = [F.col(f"r_{n}") for n in ("x", "y", "w", "h", "score")]
    wanted = (F.col("side") == "left") & F.col("left") | (F.col("side") == "right") & F.col("right")
    wider = aspect(r[2], r[3]) > F.greatest(F.lit(LEAST_ASPECT), aspect(F.col("w"), F.col("h")) + LEAST_WIDER)
    better = (aspect_prior(r[2], r[3]) >= aspect_prior(F.col("w"), F.col("h")) + LEAST_BETTER_SHAPE) & (r[4] >= F.col("score") - MOST_WORSE_SCORE)
    both = rows.join(offered, ["clip", "seq"], "left").withColumn("rank", rank(*r))
    taken = wanted & wider & better & (F.col("rank") > F.col("own_rank"))
    offer = F.struct("rank", *[c.alias(n) for c, n in zip(r, ("x", "y", "w", "h", "score"), strict=True)], "side")
    sides = both.groupBy("clip", "seq").agg(*[F.max(F.when(taken & (F.col("side") == s), offer)).alias(s) for s in ("left", "right")], F.first(F.struct("x", "y", "w", "h", "score")).alias("own"))
    near = F.abs(F.col("left.rank") - F.col("right.rank")) < SAME_RANK
    left_first = _left_ranks_first(frame_w, frame_h, cx, cy)(*[F.when(near, F.col(f"{s}.{n}")) for s in ("left", "right") for n in ("x", "y", "w", "h", "score")])
    left_wins = F.when(near, left_first).otherwise(F.col("right").isNull() | (F.col("left.rank") >= F.col("right.rank")))
    best = sides.withColumn("best", F.when(F.col("left").isNotNull() & left_wins, F.col("left")).otherwise(F.col("right")))
    return best.select("clip", "seq", *[F.coalesce(F.col(f"best.{c}"), F.col(f"own.{c}")).alias(c) for c in ("x", "y", "w", "h", "score")], F.col("best.side").alias("side"))


def _left_ranks_first(frame_w: int, frame_h: int, cx: float, cy: float):
    """Whether the first of two boxes ranks no lower than the second, by the C library's ``exp`` and ``pow``, as in databases; null boxes pass.

    Repairs to the left and to the right often mirror each other about the centre, where the last digit decides, and that of the JVM's own ``exp`` differs.
    """

    def rank(x: float, y: float, w: float, h: float, score: float) -> float:
        shape = math.exp(-math.pow((w / max(1.0, h) - 3.2) / 0.85, 2))
        off = math.pow(((x + w / 2.0) / frame_w - cx) / 0.35, 2) + math.pow(((y + h / 2.0) / frame_h - cy) / 0.28, 2)
        left, right = x / frame_w, (x + w) / frame_w
        edge = 0.20 if left < 0.03 or right > 0.97 else 0.55 if left < 0.06 or right > 0.94 else 1.0
        return shape * 0.55 + score * 0.20 + min(max(math.exp(-off) * edge, 0.0), 1.0) * 0.25

    @F.pandas_udf("boolean")
    def left_first(lx: pd.Series, ly: pd.Series, lw: pd.Series, lh: pd.Series, ls: pd.Series, rx: pd.Series, ry: pd.Series, rw: pd.Series, rh: pd.Series, rs: pd.Series) -> pd.Series:
        out = pd.Series(False, index=lx.index)
        for i in lx.index[lx.notna()]:
            out[i] = rank(*(float(v[i]) for v in (lx, ly, lw, lh, ls))) >= rank(*(float(v[i]) for v in (rx, ry, rw, rh, rs)))
        return out

    return left_first
