"""Segmentation against loops over single samples."""

import random

import numpy as np
import pytest
from cadentia.functions import boxes, scalars, sql
from cadentia.operators import segments, signal
from cadentia.operators.segments import Rules
from cadentia.streaming.replay import live_segments
from pyspark.sql import functions as F

RULES = Rules(high=0.6, low=0.3, max_gap=2.0, min_dur=1.0, long=9.0, split_gap=0.8, split_low_factor=0.9, min_split=2.0, artefact=2.8, tail_first=5.0)


def samples(clips=25, n=160, seed=3):
    rng = random.Random(seed)
    out = []
    for c in range(clips):
        t, x = 0.0, 0.5
        for i in range(n):
            t += rng.choice((0.1, 0.3, 0.5, 1.5))
            x = min(1.0, max(0.0, x + rng.uniform(-0.4, 0.4)))
            out.append((c, i, t, x))
    return out


def loop(rows, r, flush=True):
    out, active = [], False
    for _, i, t, x in rows:
        if active:
            if x > r.low:
                w = (i, t)
            if t - w[1] > r.max_gap:
                out.append((s, w))
                active = False
        elif x > r.high:
            active, s, w = True, (i, t), (i, t)
    if active and flush:
        out.append((s, w))
    return [(s[0], w[0]) for s, w in out if w[1] - s[1] > r.min_dur]


def split_loop(rows, a, b, r):
    t, x = [q[2] for q in rows], [q[3] for q in rows]
    if t[b] - t[a] <= r.long:
        return [(a, b, [])]
    cuts, run = [], []
    for i in range(a, b + 2):
        if i <= b and x[i] < r.split_low:
            run.append(i)
        elif run:
            if t[run[-1]] - t[run[0]] >= r.split_gap:
                cuts.append((run[0] + run[-1]) // 2)
            run = []
    edges = [a, *cuts, b]
    pieces = [[p, q, ["split_long"]] for p, q in zip(edges, edges[1:], strict=False)]
    if len(pieces) == 1:
        return [(a, b, ["long_unsplit"])]
    done = []
    for p in pieces:
        if done and t[done[-1][1]] - t[done[-1][0]] < r.min_split and len(done) == 1:
            done[-1] = [done[-1][0], p[1], ["split_long", "merged_short_split"]]
        elif done and t[p[1]] - t[p[0]] < r.min_split:
            done[-1][1] = p[1]
            done[-1][2].append("merged_short_split")
        else:
            done.append(p)
    kept = [tuple(p) for p in done if t[p[1]] - t[p[0]] >= r.min_dur]
    return kept or [(a, b, ["long_unsplit"])]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(samples(), "clip long, idx long, t double, e double").repartition(3).cache()


def by_clip():
    out = {}
    for r in samples():
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("flush", [True, False])
@pytest.mark.parametrize("gap", [0.4, 1.0, 2.0])
def test_hysteresis(frame, flush, gap):
    r = Rules(**{**RULES.__dict__, "max_gap": gap})
    got = {(s.clip, s.i_start, s.i_end) for s in segments.hysteresis(frame, r, flush=flush).collect()}
    assert got == {(c, a, b) for c, rows in by_clip().items() for a, b in loop(rows, r, flush)} and got


def test_split_confidence_and_merge(frame):
    pieces = segments.split(frame, segments.hysteresis(frame, RULES), RULES)
    got = sorted((s.clip, s.i_start, s.i_end, tuple(s.flags)) for s in pieces.collect())
    want = sorted((c, p[0], p[1], tuple(p[2])) for c, rows in by_clip().items() for a, b in loop(rows, RULES) for p in split_loop(rows, a, b, RULES))
    assert got == want and any("merged_short_split" in g[3] for g in got) and any("long_unsplit" in g[3] for g in got)
    for s in segments.with_confidence(frame, pieces).collect():
        middle = np.median([r[3] for r in by_clip()[s.clip][s.i_start : s.i_end + 1]])
        assert s.confidence == pytest.approx(min(max(middle, 0.5), 1.0))
    merged = segments.segmented(frame, RULES).collect()
    spans = sorted((m.clip, m.t_start, m.t_end) for m in merged)
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(spans, spans[1:], strict=False)) and len(merged) <= len(got)


@pytest.mark.parametrize("changes", [{}, {"min_split": 0.5, "min_dur": 0.6}, {"min_split": 4.0, "split_gap": 0.2}, {"long": 2.0, "split_low_factor": 1.5}])
def test_table_function_splits_like_windows(spark, frame, changes):
    r = Rules(**{**RULES.__dict__, **changes})
    sql.register(spark, r)
    found = segments.hysteresis(frame, r)
    segments.within(frame, found).createOrReplaceTempView("samples_to_split")
    got = spark.sql("SELECT * FROM split_segments(TABLE(samples_to_split) PARTITION BY (clip, i_start) ORDER BY idx)").collect()
    shown = lambda rows: sorted((x.clip, x.i_start, x.i_end, x.t_start, x.t_end, tuple(x.flags)) for x in rows)
    assert shown(got) == shown(segments.split(frame, found, r).collect()) and len(got) > 20
    assert spark.sql("SELECT * FROM split_segments(TABLE(SELECT * FROM samples_to_split WHERE false) PARTITION BY (clip, i_start) ORDER BY idx)").count() == 0


def test_functions_in_sql_are_those_of_the_library(spark):
    sql.register(spark)
    spark.createDataFrame([(0.1, "unknown", 3725.9, 7), (0.6, "player_a", 59.99, 12345), (0.85, "player_b", 0.0, 1), (None, None, None, None)], "c double, w string, t double, n long").createOrReplaceTempView("in_sql")
    a = spark.sql("SELECT minutes_seconds(t), review_bucket(c), needs_review(w, c), label_of(concat(' x ', upper(w))), safe_divide(t, c - 0.6), interval_iou(0, t, 10, 100), point_id(n) FROM in_sql")
    c = {k: F.col(k) for k in "cwtn"}
    b = spark.table("in_sql").select(
        scalars.minutes_seconds(c["t"]), scalars.review_bucket(c["c"]), scalars.needs_review(c["w"], c["c"]), scalars.label_of(F.concat(F.lit(" x "), F.upper(c["w"]))), scalars.safe_divide(c["t"], c["c"] - 0.6),
        boxes.interval_iou(F.lit(0.0), c["t"], F.lit(10.0), F.lit(100.0)), scalars.point_id(c["n"]),
    )
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]
    assert "Python" not in a._jdf.queryExecution().executedPlan().toString()


def test_merge_rules(spark):
    def merge(*spans):
        rows = [(1, float(a), float(b), 0.1 * k + 0.4, ["split_long"]) for k, (a, b) in enumerate(spans)]
        return sorted((m.t_start, m.t_end, tuple(m.flags)) for m in segments.merged(spark.createDataFrame(rows, "clip long, t_start double, t_end double, confidence double, flags array<string>"), RULES).collect())

    own = ("split_long",)
    assert merge((0, 3), (3, 6)) == [(0, 3, own), (3, 6, own)]
    assert merge((0, 3), (3, 4)) == [(0, 4, ("merged_contiguous_artifact", "split_long"))]
    assert merge((0, 6), (6, 7), (7, 8), (8, 12)) == [(0, 6, own), (6, 12, ("merged_contiguous_tail_artifact", "split_long"))]
    assert merge((0, 1), (2, 3)) == [(0, 1, own), (2, 3, own)]


def test_filters_pad_with_zeros(spark):
    v = [float(i % 7) for i in range(30)]
    s = spark.createDataFrame([(1, i, float(i), x) for i, x in enumerate(v)], "clip long, idx long, t double, v double")
    smooth = [r.smooth for r in signal.gauss(s).orderBy("idx").collect()]
    assert smooth == pytest.approx(np.convolve(v, signal.gauss_weights(), "same").tolist())
    flat = [r.box for r in signal.box(s, 7).orderBy("idx").collect()]
    assert flat == pytest.approx(np.convolve(v, np.ones(7) / 7, "same").tolist())
    e = [r.e for r in signal.conditioned(s).orderBy("idx").collect()]
    lo, hi = np.percentile(smooth, [10, 95])
    assert e == pytest.approx(np.clip((np.array(smooth) - lo) / (hi - lo + 1e-6), 0, 1).tolist())


def test_stream_equals_batch_without_flush(spark, frame, tmp_path):
    frame.selectExpr("clip", "t", "e as x").write.parquet(str(tmp_path / "in"))
    live = live_segments(spark.readStream.schema("clip long, t double, x double").parquet(str(tmp_path / "in")), RULES)
    live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.clip, r.t_start, r.t_end) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(s.clip, s.t_start, s.t_end) for s in segments.hysteresis(frame, RULES, flush=False).collect()} and got
