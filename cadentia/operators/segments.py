"""Hysteresis segmentation, dip splitting, and merging of contiguous pieces, all as gaps and islands.

A sample is warm above the low threshold and hot above the high one. Two neighbouring warm samples belong to
different islands if the last sample before the second is more than the gap after the first: silence is
only measured at cold samples. An island with a hot sample is a segment, from its first hot sample to its
last warm one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.operators.signal import by_sample, whole_clip


@dataclass(frozen=True)
class Rules:
    high: float = 0.25
    low: float = 0.12
    max_gap: float = 2.0
    min_dur: float = 1.0
    long: float = 12.0
    split_gap: float = 0.55
    split_low_factor: float = 0.65
    min_split: float = 2.0
    eps: float = 0.05
    artefact: float = 2.8
    tail_pieces: int = 4
    tail_first: float = 8.0

    @property
    def split_low(self) -> float:
        return max(0.02, self.low * self.split_low_factor)


def hysteresis(s: DataFrame, rules: Rules, value: str = "e", flush: bool = True) -> DataFrame:
    """clip, t_start, t_end, i_start and i_end of each segment; without flush, one still open at the end of the clip is dropped."""
    if rules.low > rules.high:
        raise ValueError("the low threshold is above the high one")
    rows = s.select("clip", "idx", "t", F.col(value).alias("x"), F.lag("t").over(by_sample()).alias("before"), F.max("t").over(whole_clip()).alias("last"))
    warm = rows.where(F.col("x") > rules.low).withColumn("warm_before", F.lag("t").over(by_sample()))
    island = F.sum(F.when(F.col("before") - F.col("warm_before") > rules.max_gap, 1).otherwise(0)).over(by_sample())
    hot = F.col("x") > rules.high
    found = warm.withColumn("island", island).groupBy("clip", "island").agg(
        F.min(F.when(hot, F.col("t"))).alias("t_start"), F.max("t").alias("t_end"), F.min(F.when(hot, F.col("idx"))).alias("i_start"), F.max("idx").alias("i_end"), F.max("last").alias("last")
    )
    found = found.where(F.col("t_end") - F.col("t_start") > rules.min_dur)
    if not flush:
        found = found.where(F.col("last") - F.col("t_end") > rules.max_gap)
    return found.select("clip", "t_start", "t_end", "i_start", "i_end")


def within(s: DataFrame, spans: DataFrame, value: str = "e") -> DataFrame:
    """idx, t and x of each sample with the columns of the span that covers it, by windows over samples and starts of spans.

    Spans of a clip may touch but not overlap; a sample where two touch comes once for each of them. Samples
    outside of all spans go, and spans without samples.
    """
    columns = [c for c in spans.columns if c != "clip"]
    starts = spans.select("clip", F.col("i_start").alias("idx"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("x"), F.struct(*columns).alias("span"))
    rows = s.select("clip", "idx", F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("x"), F.lit(None).cast(starts.schema["span"].dataType).alias("span")).unionByName(starts)
    before, here = (F.last("span", ignorenulls=True).over(by_sample().rangeBetween(Window.unboundedPreceding, to)) for to in (-1, 0))
    covering = F.filter(F.array_distinct(F.array("before", "here")), lambda p: p["i_end"] >= F.col("idx"))
    rows = rows.select("clip", "idx", "t", "x", "span", before.alias("before"), here.alias("here")).where("span is null")
    return rows.select("clip", "idx", "t", "x", F.explode(covering).alias("span")).select("clip", "idx", "t", "x", "span.*")


def split(s: DataFrame, segments: DataFrame, rules: Rules, value: str = "e") -> DataFrame:
    """clip, t_start, t_end, i_start, i_end and flags of the pieces that long segments of ``s`` are split into; others pass.

    Long segments are cut in the middle of dips that last. Too short pieces join the one on their left, or
    while none is long enough yet, the one on their right. All windows share the partitioning by clip.
    """
    inside = within(s, segments.select("clip", "t_start", "t_end", "i_start", "i_end"), value)
    order = Window.partitionBy("clip", "i_start").orderBy("idx")
    whole = Window.partitionBy("clip", "i_start")
    long = F.col("t_end") - F.col("t_start") > rules.long
    inside = inside.withColumn("dip", F.coalesce(long & (F.col("x") < rules.split_low), F.lit(False)))
    follows = F.lag("dip", 1, False).over(order) & (F.lag("idx").over(order) == F.col("idx") - 1)
    inside = inside.withColumn("run", F.sum((F.col("dip") & ~follows).cast("int")).over(order))
    dip = Window.partitionBy("clip", "i_start", "dip", "run")
    middle = F.floor((F.min("idx").over(dip) + F.max("idx").over(dip)) / 2)
    lasts = F.max("t").over(dip) - F.min("t").over(dip)
    inside = inside.select("*", middle.alias("middle"), lasts.alias("lasts"))
    cut = F.col("dip") & (F.col("idx") == F.col("middle")) & (F.col("lasts") >= rules.split_gap) & (F.col("idx") > F.col("i_start"))
    points = inside.where((F.col("idx") == F.col("i_end")) | cut).select("clip", "i_start", F.col("idx").alias("at"), F.col("t").alias("at_t"), F.col("t_start").alias("seg_t"), F.col("t_end").alias("seg_end"), F.col("i_end").alias("seg_i_end"))
    order = Window.partitionBy("clip", "i_start").orderBy("at")
    pieces = points.select(
        "*", F.coalesce(F.lag("at").over(order), F.col("i_start")).alias("from_i"), F.coalesce(F.lag("at_t").over(order), F.col("seg_t")).alias("from_t"), F.count("*").over(whole).alias("n")
    )
    # The leading group ends with the first piece whose end is far enough from the segment's start; later pieces open a group if long enough themselves.
    reached = (F.col("at_t") - F.col("seg_t") >= rules.min_split).cast("int")
    pieces = pieces.withColumn("before", F.coalesce(F.max(reached).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = pieces.withColumn("reached", F.max(reached).over(whole))
    opens = F.when(F.col("before") == 1, (F.col("at_t") - F.col("from_t") >= rules.min_split).cast("int")).otherwise(0)
    pieces = pieces.withColumn("leading", F.col("before") == 0).withColumn("group", F.sum(opens).over(order))
    groups = pieces.groupBy("clip", F.col("i_start").alias("seg"), "group", "n", "reached", "seg_t", "seg_end", "seg_i_end").agg(
        F.min("from_i").alias("i_start"), F.max("at").alias("i_end"), F.min("from_t").alias("t_start"), F.max("at_t").alias("t_end"), F.count_if("leading").alias("n_leading"), F.count_if(~F.col("leading")).alias("n_later")
    )
    # One flag for a merged beginning, one for each piece that joined from the right.
    joined = F.when(F.col("group") == 0, (F.col("n_leading") > 1).cast("int") + F.col("n_later")).otherwise(F.col("n_later") - 1).cast("int")
    split_flags = F.concat(F.array(F.lit("split_long")), F.array_repeat(F.lit("merged_short_split"), joined))
    whole_flags = F.when(F.col("seg_end") - F.col("seg_t") > rules.long, F.array(F.lit("long_unsplit"))).otherwise(F.array().cast("array<string>"))
    keep = (F.col("n") > 1) & (F.col("reached") == 1) & (F.col("t_end") - F.col("t_start") >= rules.min_dur)
    groups = groups.withColumn("keep", keep).withColumn("kept", F.max("keep").over(Window.partitionBy("clip", "seg")))
    # A segment none of whose pieces is kept passes whole, in the row of its first piece.
    groups = groups.where(F.col("keep") | (~F.col("kept") & (F.col("group") == 0)))
    own = {"t_start": "seg_t", "t_end": "seg_end", "i_start": "seg", "i_end": "seg_i_end"}
    return groups.select("clip", *[F.when(F.col("keep"), F.col(c)).otherwise(F.col(o)).alias(c) for c, o in own.items()], F.when(F.col("keep"), split_flags).otherwise(whole_flags).alias("flags"))


def with_confidence(s: DataFrame, pieces: DataFrame, value: str = "e") -> DataFrame:
    """The pieces with the median of their samples, clamped to [0.5, 1]. A sample on a border counts for both sides."""
    covered = within(s, pieces.select("clip", "t_start", "t_end", "i_start", "i_end", "flags"), value)
    middle = covered.groupBy("clip", "t_start", "t_end", "i_start", "i_end", "flags").agg(F.median("x").alias("m"))
    return middle.select("clip", "t_start", "t_end", "i_start", "i_end", "flags", F.least(F.greatest(F.col("m"), F.lit(0.5)), F.lit(1.0)).alias("confidence"))


def merged(pieces: DataFrame, rules: Rules) -> DataFrame:
    """clip, t_start, t_end, confidence and flags after runs of touching pieces with a too short one among them are merged.

    A run of several pieces whose first is long keeps that and merges the rest.
    """
    order = Window.partitionBy("clip").orderBy("t_start", "t_end")
    run = F.sum(F.when(F.col("t_start") - F.lag("t_end").over(order) <= rules.eps, 0).otherwise(1)).over(order)
    rows = pieces.withColumn("run", run)
    whole = Window.partitionBy("clip", "run")
    inside = Window.partitionBy("clip", "run").orderBy("t_start", "t_end")
    length = F.col("t_end") - F.col("t_start")
    rows = rows.select("*", F.row_number().over(inside).alias("k"), F.count("*").over(whole).alias("n"), F.min(length).over(whole).alias("shortest"), F.first(length).over(inside).alias("first_length"))
    merge = (F.col("n") > 1) & (F.col("shortest") < rules.artefact)
    tail = merge & (F.col("n") >= rules.tail_pieces) & (F.col("first_length") >= rules.tail_first)
    part = F.when(tail, F.least("k", F.lit(2))).when(merge, 1).otherwise(F.col("k"))
    tag: Column = F.when(tail & (F.col("k") > 1), "merged_contiguous_tail_artifact").when(merge & ~tail, "merged_contiguous_artifact")
    rows = rows.withColumn("tag", tag).withColumn("part", part)
    out = rows.groupBy("clip", "run", "part", "tag").agg(
        F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.median("confidence").alias("middle"), F.first("confidence").alias("own"), F.flatten(F.collect_list("flags")).alias("all_flags"), F.first("flags").alias("own_flags")
    )
    flags = F.when(F.col("tag").isNull(), F.col("own_flags")).otherwise(F.array_sort(F.array_distinct(F.array_append("all_flags", F.col("tag")))))
    confidence = F.when(F.col("tag").isNull(), F.col("own")).otherwise(F.least(F.greatest(F.col("middle"), F.lit(0.5)), F.lit(1.0)))
    return out.select("clip", "t_start", "t_end", confidence.alias("confidence"), flags.alias("flags"))


def segmented(s: DataFrame, rules: Rules, value: str = "e") -> DataFrame:
    """All steps, from a conditioned signal to merged segments."""
    return merged(with_confidence(s, split(s, hysteresis(s, rules, value), rules, value), value), rules)
