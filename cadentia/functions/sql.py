"""The library in SQL: scalar functions that Catalyst puts in place, and a table function that splits segments.

``register(spark)`` makes them known to a session:

    SELECT review_bucket(confidence), minutes_seconds(t) FROM points
    SELECT * FROM split_segments(TABLE(samples) PARTITION BY (clip, i_start) ORDER BY idx)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from cadentia.operators.segments import Rules

#: Names, parameters, result types and bodies, each the same as the column function of that name in ``scalars`` or ``boxes``.
FUNCTIONS = [
    ("minutes_seconds", "t DOUBLE", "STRING", "format_string('%02d:%02d', CAST(floor(floor(t) / 60) AS BIGINT), floor(t) % 60)"),
    ("review_bucket", "confidence DOUBLE", "STRING", "CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.60 THEN 'review' ELSE 'block' END"),
    ("needs_review", "winner STRING, confidence DOUBLE", "BOOLEAN", "winner = 'unknown' OR review_bucket(confidence) <> 'auto'"),
    ("label_of", "said STRING", "STRING", "CASE WHEN contains(lower(trim(said)), 'player_a') THEN 'player_a' WHEN contains(lower(trim(said)), 'player_b') THEN 'player_b' ELSE 'unknown' END"),
    ("safe_divide", "n DOUBLE, d DOUBLE", "DOUBLE", "CASE WHEN d > 0 THEN n / d ELSE 0D END"),
    ("interval_iou", "a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "DOUBLE", "CASE WHEN least(a1, b1) > greatest(a0, b0) THEN (least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) ELSE 0D END"),
    ("point_id", "ordinal BIGINT", "STRING", "format_string('pt_%04d', ordinal)"),
]


def splitter(rules: Rules) -> type:
    """A table function over the samples of segments: clip, idx, t, x, t_start, t_end, i_start and i_end, one segment a partition, by idx.

    It holds one segment's cuts and the dip it is in, not its samples, and gives the pieces that ``segments.split`` does.
    """

    class SplitSegments:
        def __init__(self):
            self.segment, self.cuts, self.dip = None, [], []

        def _end_dip(self) -> None:
            """A dip that lasts is cut at its middle sample; of the dip first, last and the samples' times by number are held."""
            if self.dip and self.dip[-1][1] - self.dip[0][1] >= rules.split_gap:
                middle = (self.dip[0][0] + self.dip[-1][0]) // 2
                cut = next(s for s in self.dip if s[0] == middle)
                if cut[0] > self.segment["i_start"]:
                    self.cuts.append(cut)
            self.dip = []

        def eval(self, sample: Row) -> None:
            self.segment = self.segment or sample.asDict()
            if sample["t_end"] - sample["t_start"] > rules.long and sample["x"] is not None and sample["x"] < rules.split_low:
                self.dip.append((sample["idx"], sample["t"]))
            else:
                self._end_dip()

        def _groups(self, ends: list[tuple]) -> Iterator[list]:
            """First and last sample of each group of pieces, and the number of pieces that joined it: the first group goes on until it is long enough, later ones begin with a long enough piece."""
            s, group = self.segment, None
            before = (s["i_start"], s["t_start"])
            for at in ends:
                if group is None:
                    group = [before, at, 0]
                elif group[0][0] == s["i_start"] and group[1][1] - s["t_start"] < rules.min_split:
                    group[1:] = at, 1
                elif at[1] - before[1] >= rules.min_split:
                    yield group
                    group = [before, at, 0]
                else:
                    group[1:] = at, group[2] + 1
                before = at
            yield group

        def terminate(self) -> Iterator[tuple]:
            if self.segment is None:
                return
            self._end_dip()
            s = self.segment
            ends = [c for c in self.cuts if c[0] != s["i_end"]] + [(s["i_end"], s["t_end"])]
            split = len(ends) > 1 and s["t_end"] - s["t_start"] >= rules.min_split
            kept = [g for g in self._groups(ends) if g[1][1] - g[0][1] >= rules.min_dur] if split else []
            for (i0, t0), (i1, t1), joined in kept:
                yield s["clip"], t0, t1, i0, i1, ["split_long"] + ["merged_short_split"] * joined
            if not kept:
                yield s["clip"], s["t_start"], s["t_end"], s["i_start"], s["i_end"], ["long_unsplit"] if s["t_end"] - s["t_start"] > rules.long else []

    return SplitSegments


def register(spark: SparkSession, rules: Rules | None = None) -> None:
    """Make the functions known to the session; ``split_segments`` splits by ``rules``."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    split = udtf(splitter(rules or Rules()), returnType="clip BIGINT, t_start DOUBLE, t_end DOUBLE, i_start BIGINT, i_end BIGINT, flags ARRAY<STRING>")
    spark.udtf.register("split_segments", split)
