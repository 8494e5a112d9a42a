"""Detection and voting over ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.sources.stream import written


def refractory(s: DataFrame, threshold: float, gap: float, value: str = "v") -> DataFrame:
    """clip, t and value of samples at or above the threshold, each at least ``gap`` after the last one given.

    The first sample of a clip only starts it. A window drops that and what is below the threshold; the fold
    streams over the rest in order and holds one number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, last, started = None, None, False
        for batch in batches:
            out = []
            for c, i, t, v in zip(*(batch.column(k).to_pylist() for k in ("clip", "idx", "t", "x")), strict=True):
                if not started or c != clip:
                    clip, last, started = c, None, True
                if last is None or t - last >= gap:
                    last = t
                    out.append((c, i, t, v))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["clip", "idx", "t", "value"])

    later = F.lag(F.lit(True)).over(Window.partitionBy("clip").orderBy("idx"))
    rows = s.select("clip", "idx", "t", F.col(value).cast("double").alias("x")).withColumn("later", later)
    rows = rows.where(F.col("later") & (F.col("x") >= threshold) & ~F.isnan("x")).select("clip", "idx", "t", "x").sortWithinPartitions("clip", "idx")
    return rows.mapInArrow(run, "clip long, idx long, t double, value double")


def _hot(s: DataFrame, threshold: float, value: str) -> DataFrame:
    """clip, idx, t and value of samples at or above the threshold, without the first sample of each clip."""
    rows = s.select("clip", "idx", "t", F.col(value).cast("double").alias("value"))
    first = rows.groupBy("clip").agg(F.min("idx").alias("first"))  # partial minima: no task holds a clip
    rows = rows.where((F.col("value") >= threshold) & ~F.isnan("value")).join(first, "clip")
    return rows.where(F.col("idx") > F.col("first")).drop("first")


def _successors(hot: DataFrame, gap: float, since: str = "t") -> DataFrame:
    """clip, idx and next: the first hot sample at least ``gap`` later than ``since``, for those that have one.

    Samples (at t) and questions (at since + gap) are dealt by ranges of clip and time. A window in each range finds the next sample; a
    question that no sample of its range answers takes the first one of the clip's next range that has any.
    """
    spark = hot.sparkSession
    there = hot.select("clip", F.col("t").alias("at"), F.lit(1).alias("there"), "idx")
    asked = hot.select("clip", (F.col(since) + gap).alias("at"), F.lit(0).alias("there"), "idx")
    ranges = there.unionByName(asked).repartitionByRange("clip", "at", "there", "idx").withColumn("part", F.spark_partition_id())
    ranges = written(spark, ranges, "refractory-ranges")
    ahead = Window.partitionBy("clip", "part").orderBy("at", "there", "idx").rowsBetween(0, Window.unboundedFollowing)
    found = ranges.withColumn("next", F.first(F.when(F.col("there") == 1, F.col("idx")), ignorenulls=True).over(ahead)).where("there = 0")
    # One row for each range that a clip lies in.
    firsts = ranges.groupBy("clip", "part").agg(F.min(F.when(F.col("there") == 1, F.struct("at", "idx"))).alias("first"))
    later = F.first("first.idx", ignorenulls=True).over(Window.partitionBy("clip").orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    found = found.join(firsts.select("clip", "part", later.alias("later")), ["clip", "part"])
    return found.select("clip", "idx", F.coalesce("next", "later").alias("next")).where("next is not null")


def _by_range(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """clip, part and rows of each clip's part of a range, of rows sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        clip, part = batch.column("clip").to_numpy(), batch.column("part").to_numpy()
        cuts = np.flatnonzero((np.diff(clip) != 0) | (np.diff(part) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi == lo:
                continue
            if held and (held[0].column("clip")[0].as_py(), held[0].column("part")[0].as_py()) != (clip[lo], part[lo]):
                yield held[0].column("clip")[0].as_py(), held[0].column("part")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0].column("clip")[0].as_py(), held[0].column("part")[0].as_py(), pa.Table.from_batches(held)


def _ways_through(ranges: DataFrame, gap: float) -> DataFrame:
    """clip, part, idx and t of the samples at which a range can be entered, and ``leaves``: the time from which the next sample after the range is looked for.

    What was found last before a range is before its first sample, so a range is entered within a gap of that, or at the first sample after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clip, part, rows in _by_range(batches):
            t = rows.column("t").to_numpy()
            after = np.searchsorted(t, t + gap)
            leaves = t + gap
            # Each sample points at a later one: where that is known to leave, so does this.
            for i in range(len(t) - 1, -1, -1):
                if after[i] < len(t):
                    leaves[i] = leaves[after[i]]
            n = min(after[0] + 1, len(t))
            yield pa.RecordBatch.from_arrays([pa.array([clip] * n, pa.int64()), pa.array([part] * n, pa.int32()), rows.column("idx").slice(0, n).combine_chunks(), pa.array(t[:n]), pa.array(leaves[:n])], names=["clip", "part", "idx", "t", "leaves"])

    return ranges.mapInArrow(run, "clip long, part int, idx long, t double, leaves double")


def refractory_by_jumps(s: DataFrame, threshold: float, gap: float, value: str = "v") -> DataFrame:
    """What ``refractory`` finds, for clips too long for one task: a clip's samples are spread over all of them.

    Hot samples are dealt to ranges of clip and time. Each range is walked backwards once, which tells for every sample at which it can be
    entered where the way through it leaves. Those few samples point at ones of later ranges, and which of them are reached from a clip's
    first hot sample is found by pointer doubling, in as many rounds as the logarithm of the number of ranges. Then each range is walked from
    where it is entered. Needs times in the order of idx; a time plus the gap should be exact. A task holds one range.
    """
    spark = s.sparkSession
    hot = _hot(s, threshold, value)
    ranges = hot.repartitionByRange("clip", "t", "idx").withColumn("part", F.spark_partition_id())
    ranges = written(spark, ranges.select("clip", "part", "idx", "t", "value"), "refractory-ranges")
    whole = ranges.repartition("clip", "part").sortWithinPartitions("clip", "part", "t", "idx")
    ways = written(spark, _ways_through(whole, gap), "refractory-ways")
    jumps = written(spark, _successors(ways, 0.0, "leaves"), "refractory-jumps")
    reached = ways.groupBy("clip").agg(F.min_by("idx", F.struct("t", "idx")).alias("idx"))
    while True:
        more = written(spark, reached.join(jumps, ["clip", "idx"]).select("clip", F.col("next").alias("idx")), "refractory-reached")
        if more.isEmpty():
            break
        reached = written(spark, reached.unionByName(more), "refractory-reached")
        twice = jumps.select("clip", F.col("idx").alias("from"), F.col("next").alias("idx")).join(jumps, ["clip", "idx"])
        jumps = written(spark, twice.select("clip", F.col("from").alias("idx"), "next"), "refractory-jumps")
    entered = ways.join(reached, ["clip", "idx"]).groupBy("clip", "part").agg(F.min("t").alias("from_t"), F.min_by("idx", "t").alias("from_idx"))
    walked = ranges.join(entered, ["clip", "part"]).where("t > from_t or t = from_t and idx >= from_idx").select("clip", "part", "idx", "t", "value")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _by_range(batches):
            t, found, i = rows.column("t").to_numpy(), [], 0
            while i < len(t):
                found.append(i)
                i = int(np.searchsorted(t, t[i] + gap))
            yield from rows.take(pa.array(found)).select(["clip", "idx", "t", "value"]).combine_chunks().to_batches()

    return walked.repartition("clip", "part").sortWithinPartitions("clip", "part", "t", "idx").mapInArrow(walk, "clip long, idx long, t double, value double")


def majority(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """key, winner and consensus: the most frequent vote and its share; unknown and 0 if two are equally frequent."""
    counts = votes.groupBy(key, vote).agg(F.count("*").alias("n"))
    tally = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by(vote, "n").alias("leader"), F.array_sort(F.collect_list("n")).alias("ns"))
    tie = F.coalesce(F.try_element_at("ns", F.lit(-2)) == F.col("top"), F.lit(False))
    return tally.select(key, F.when(tie, "unknown").otherwise(F.col("leader")).alias("winner"), F.when(tie, 0.0).otherwise(F.col("top") / F.col("total")).alias("consensus"))


#: A consensus below this is flagged; two of three votes are.
LOW_CONSENSUS = 0.67


def refined(points: DataFrame, votes: DataFrame, key: str = "id") -> DataFrame:
    """Points whose unknown winners are replaced by a vote; others, and those without votes, stay as they are."""
    from cadentia.functions.scalars import with_flag

    v = majority(votes, key, "vote").select(key, F.col("winner").alias("voted"), "consensus")
    rows = points.join(v, key, "left")
    open_ = (F.col("winner") == "unknown") & F.col("voted").isNotNull()
    return rows.select(
        *[c for c in points.columns if c not in ("winner", "confidence", "flags")],
        F.when(open_, F.col("voted")).otherwise(F.col("winner")).alias("winner"),
        F.when(open_ & (F.col("consensus") > 0), F.col("consensus")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(open_ & (F.col("consensus") < LOW_CONSENSUS), with_flag(F.col("flags"), "winner_low_consensus")).otherwise(F.col("flags")).alias("flags"),
    )


def flip_suggestions(points: DataFrame, expected_a: int, expected_b: int, top: int = 10, key: str = "clip") -> DataFrame:
    """The fewest winner changes that give the expected score where totals agree: least confident first, then longest."""
    side = lambda w: F.count_if(F.col("winner") == w)
    plan = points.groupBy(key).agg((F.lit(expected_a) - side("player_a")).alias("da"), (F.lit(expected_b) - side("player_b")).alias("db"))
    plan = plan.where("da = -db and da <> 0").select(key, F.abs("da").alias("needed"), F.when(F.col("da") < 0, "player_a").otherwise("player_b").alias("from_winner"))
    ranked = points.join(plan, key).where(F.col("winner") == F.col("from_winner"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("confidence", F.desc(F.col("t_end") - F.col("t_start")), "seq"))
    ranked = ranked.withColumn("place", place).where(F.col("place") <= F.least("needed", F.lit(top)))
    return ranked.select(key, "place", "seq", "from_winner", F.when(F.col("from_winner") == "player_a", "player_b").otherwise("player_a").alias("to_winner"), "needed")


def correction_outcomes(points: DataFrame, expected_a: int, expected_b: int, key: str = "clip") -> DataFrame:
    """key, delta_a, delta_b, n_unknown and outcome: flips, none (the score is as expected) or segmentation_error (no flip can give the total)."""
    side = lambda w: F.count_if(F.col("winner") == w)
    rows = points.groupBy(key).agg((F.lit(expected_a) - side("player_a")).cast("long").alias("delta_a"), (F.lit(expected_b) - side("player_b")).cast("long").alias("delta_b"), side("unknown").alias("n_unknown"))
    return rows.withColumn("outcome", F.when(F.col("delta_a") + F.col("delta_b") != 0, "segmentation_error").when(F.col("delta_a") == 0, "none").otherwise("flips"))


def nearest(rows: DataFrame, group: list[str], distance, k: int, tie: str) -> DataFrame:
    """The k rows of each group with the smallest distance."""
    return rows.withColumn("distance", distance).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("distance", tie))).where(F.col("place") <= k)


def wrist_speed(rows: DataFrame, most: float = 0.5) -> DataFrame:
    """Largest way of either wrist since the player's frame before, over the body height; ways of ``most`` or more count as 0. Needs clip, player, idx, lx, ly, rx, ry and height."""
    w = Window.partitionBy("clip", "player").orderBy("idx")
    way = lambda x, y: F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)) / F.col("height")
    kept = F.filter(F.array(way("lx", "ly"), way("rx", "ry")), lambda v: v < most)
    return rows.withColumn("speed", F.when(F.col("height") > 0, F.coalesce(F.array_max(kept), F.lit(0.0))).otherwise(0.0))
