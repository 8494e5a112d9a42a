"""Streams of tables of one and of many files, and their order."""

import random
from pathlib import Path

import duckdb
import pandas as pd
import pyspark.sql
from cadentia.operators import score
from cadentia.operators.segments import Rules
from cadentia.plans.queries import STREAM_PARTS, oracle_sql, queries
from cadentia.sources import stream
from cadentia.streaming import ordered, replay

ROOT = "/root/testdata/sf0.001"


def test_folder_of_files_streams_like_one_file(spark, tmp_path):
    spark.read.parquet(f"{ROOT}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_score", "stream_segments", "stream_machines"):
        one, many = (sorted(map(str, queries()[name](spark, str(d)).collect())) for d in (ROOT, tmp_path))
        assert one and one == many


def test_order_by_runs(monkeypatch):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 40)), rng.choice("ab")) for i in range(500)]
    frames = [pd.DataFrame(rows[i : i + 30], columns=["seq", "ts", "winner"]) for i in range(0, 500, 30)]
    for most in (10_000, 70, 500):
        monkeypatch.setattr(replay, "RUN_ROWS", most)
        assert [tuple(r) for r in replay._in_order(iter(frames), ["ts", "seq"])] == sorted(rows, key=lambda r: (r[1], r[0]))
        assert [tuple(r) for r in replay._in_order(iter(frames), ["ts"])] == sorted(rows, key=lambda r: r[1])


def _collected(spark, parts, schema, operator):
    rows = stream.files_in_turn(spark, [spark.createDataFrame(p, schema).coalesce(1) for p in parts], "test-parts")
    with ordered.keyed_state(spark):
        return [tuple(r) for r in stream.drained(spark, operator(rows), "test-ordered").collect()]


def test_silence_closes_without_a_sample_and_late_rows_come_out(spark):
    rules = Rules(high=0.5, low=0.2, max_gap=2.0, min_dur=0.5)
    parts = [
        [(1, 2, 1.0, 0.3), (1, 1, 0.0, 0.9), (1, 3, 1.5, None)],  # disordered, with a gap in the signal
        [(2, 4, 100.0, 0.9)],
        [(1, 5, 5.0, 0.9), (2, 6, 101.0, 0.9), (2, 7, 103.5, 0.9)],  # 5.0 is behind the watermark of 90
        [(3, 8, 200.0, 0.1)],
    ]
    found = _collected(spark, parts, "clip long, seq long, t double, x double", lambda rows: ordered.ordered_segments(rows, rules, "10 seconds"))
    # 101.0 and 103.5 are farther apart than the gap; what starts at 103.5 is too short.
    assert sorted(found, key=str) == sorted([(1, None, None, False, 0.0, 1.0), (1, 5, 5.0, True, None, None), (2, None, None, False, 100.0, 101.0)], key=str)


def test_any_order_of_arrival_gives_the_batch_timeline(spark):
    rng = random.Random(11)
    rows = [(m, k, float(rng.randint(0, 300)), rng.choice(["player_a", "player_b"])) for m in (1, 2) for k in range(150)]
    want = sorted(map(str, score.timeline(spark.createDataFrame(rows, "match_id long, seq long, ts double, winner string"), 3).collect()))
    for seed in (1, 2):
        shuffled = random.Random(seed).sample(rows, len(rows))
        parts = [shuffled[:100], shuffled[100:110], shuffled[110:], [(-1, -1, 1e6, None)]]
        found = _collected(spark, parts, "match_id long, seq long, ts double, winner string", lambda rows: ordered.ordered_timeline(rows, 3, "400 seconds"))
        assert not any(r[3] for r in found)
        assert sorted(str(pyspark.sql.Row(**dict(zip(_TIMELINE, (*r[:3], *r[4:]), strict=True)))) for r in found) == want


_TIMELINE = ["match_id", "seq", "ts", "set_number", "score_a", "score_b", "sets_a", "sets_b", "is_finished", "winner"]


def test_parts_of_many_files_are_one_batch_each(spark):
    """Matches share few calls of the state, however many there are, and a part's files are taken at once; late rows and scores stay those of each match."""
    calls = []
    rng = random.Random(4)
    rows = [(m, 100 * m + k, float(rng.randint(0, 300)), rng.choice(["player_a", "player_b"])) for m in range(40) for k in range(20)]
    late = [(7, 9001, 1.0, "player_a"), (39, 9002, 2.0, None)]
    schema = "match_id long, seq long, ts double, winner string"
    parts = [spark.createDataFrame(p, schema).repartition(n) for p, n in ((rows[:400], 6), (rows[400:] + [(-1, -1, 1e6, "player_a")], 5), (late, 2), ([(-2, -2, 1e7, "player_a")], 1))]

    def live(stream_rows):
        calls.append(1)
        return ordered.ordered_timeline(stream_rows, 3, "400 seconds", groups=3)

    with ordered.keyed_state(spark):
        found = [tuple(r) for r in stream.drained_in_turn(spark, parts, live, "test-in-turn").collect()]
    assert len(calls) == len(parts) and ordered.groups_for(6_000_000) == 732
    assert sorted(r[:4] for r in found if r[3]) == [(7, 9001, 1.0, True), (39, 9002, 2.0, True)]
    want = sorted(map(str, score.timeline(spark.createDataFrame(rows, schema), 3).collect()))
    got = [r for r in found if not r[3] and r[0] >= 0]
    assert sorted(str(pyspark.sql.Row(**dict(zip(_TIMELINE, (*r[:3], *r[4:]), strict=True)))) for r in got) == want


def test_batches_and_partitions_of_the_state_follow_the_stream(spark):
    """Micro-batches and partitions of the state cost time even when they are empty: a part has one batch, the last one two, and a small stream few partitions. Rows are those of the SQL."""
    duckdb.sql(f"create or replace view events as select * from '{ROOT}/events.parquet'")
    setting = "spark.sql.shuffle.partitions"
    shared, before = Path(stream.shared_dir(spark).removeprefix("file://")), spark.conf.get(setting)
    numbered = lambda at: [p for p in at.iterdir() if p.name.isdigit()]
    spark.conf.set(setting, "9")
    try:
        for name, folder, parts in (("stream_silent_segments", "ordered-segments", STREAM_PARTS + 1), ("stream_ordered_score", "ordered-score", STREAM_PARTS + 2)):
            others = set(shared.glob(f"{folder}-*"))
            found = queries()[name](spark, ROOT)
            (at,) = set(shared.glob(f"{folder}-*")) - others
            assert len(numbered(at / "state" / "offsets")) == parts + 1
            assert len(numbered(at / "state" / "state" / "0")) == spark.sparkContext.defaultParallelism == 4
            want = duckdb.sql(f"select {', '.join(found.columns)} from ({oracle_sql()[name]})").fetchall()
            assert want and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
            assert spark.conf.get(setting) == "9" and spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    finally:
        spark.conf.set(setting, before)


def test_rows_that_go_out_with_the_next_part_are_the_same(spark):
    """Late rows at, just before and just after the watermark, and segments that only silence closes."""
    rules = Rules(high=0.5, low=0.2, max_gap=2.0, min_dur=0.5)
    parts = [
        [(1, 2, 1.0, 0.3), (1, 1, 0.0, 0.9), (2, 3, 99.0, 0.9), (2, 4, 100.0, 0.9)],
        [(1, 5, 90.0, 0.9), (1, 6, 89.999, 0.9), (1, 7, 90.001, 0.9), (1, 8, 91.0, 0.9), (3, 9, 150.0, 0.1)],
        [(1, 10, 91.5, 0.9), (3, 11, 141.0, 0.9), (3, 12, 142.0, 0.9), (3, 13, 160.0, 0.1)],
        [(-1, -1, 1e6, None)],
    ]
    frames = [spark.createDataFrame(p, "clip long, seq long, t double, x double").repartition(2) for p in parts]
    with ordered.keyed_state(spark, 3):
        found = [sorted(map(str, map(tuple, stream.drained_in_turn(spark, frames, lambda rows: ordered.ordered_segments(rows, rules, "10 seconds", 3), "test-settled", settled).collect()))) for settled in (True, False)]
    late = [(1, 5, 90.0, True, None, None), (1, 6, 89.999, True, None, None), (1, 10, 91.5, True, None, None)]
    kept = [(1, None, None, False, 0.0, 1.0), (2, None, None, False, 99.0, 100.0), (1, None, None, False, 90.001, 91.0), (3, None, None, False, 141.0, 142.0)]
    assert found[0] == found[1] == sorted(map(str, late + kept))
