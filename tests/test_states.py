"""Replays by sets, saved states and resumed replays, pointer doubling, and tables that change as a whole."""

import random

import pytest
from cadentia.operators import events, score
from cadentia.sources import documents, publish

SCHEMA = "match_id long, seq long, ts double, winner string"


def matches(n, seed):
    """Matches of up to 160 points, some of them one-sided, with equal times."""
    rng = random.Random(seed)
    rows = []
    for m in range(n):
        bias = rng.choice((0.05, 0.4, 0.5, 0.5, 0.9))
        rows += [(m, k, float(k // rng.choice((1, 2))), "player_a" if rng.random() < bias else "player_b") for k in range(rng.randint(1, 160))]
    return rows


@pytest.mark.parametrize("best_of", [1, 3, 5, 7])
def test_replay_by_sets_equals_the_fold(spark, best_of):
    rows = spark.createDataFrame(matches(25, best_of), SCHEMA)
    assert sorted(map(str, score.replay_by_sets(rows, best_of).collect())) == sorted(map(str, score.replay(rows, best_of).collect()))


def test_replay_by_sets_has_one_exchange_and_refuses_what_the_fold_refuses(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, "player_a"), (1, 2, 1.0, "nobody")], SCHEMA)
    plan = score.replay_by_sets(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "MapInArrow" not in plan
    with pytest.raises(Exception, match="unknown winner"):
        score.replay_by_sets(rows).collect()
    with pytest.raises(ValueError, match="odd"):
        score.replay_by_sets(rows, 4)


@pytest.mark.parametrize("best_of", [1, 3, 5])
def test_resumed_halves_equal_one_run(spark, tmp_path, best_of):
    rows = sorted(matches(25, 10 + best_of), key=lambda r: (r[2], r[1]))
    whole = {(r.match_id, r.seq): r for r in score.timeline(spark.createDataFrame(rows, SCHEMA), best_of).collect()}
    cut = [r for r in rows if r[2] < 30], [r for r in rows if r[2] >= 30]
    first, second = (spark.createDataFrame(part, SCHEMA) for part in cut)
    documents.write_states(score.match_states(first, best_of), f"{tmp_path}/states")
    states = documents.read_states(spark, f"{tmp_path}/states")
    resumed = {(r.match_id, r.seq): r for r in score.resumed(second, states, best_of).collect()}
    assert resumed == {k: r for k, r in whole.items() if r.ts >= 30} and len(resumed) > 100
    # The state after both halves is that of one run, whether or not a match went on.
    state = lambda s: sorted(map(str, s.collect()))
    assert state(score.match_states(second, best_of, states)) == state(score.match_states(spark.createDataFrame(rows, SCHEMA), best_of))


def test_states_are_checked(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, "player_a")], SCHEMA)
    states = score.match_states(rows, 3)
    saved = states.first()
    assert (saved.schema_version, saved.best_of, [tuple(s) for s in saved.sets], saved.winner, saved.is_finished, saved.last_ts) == ("1.0", 3, [(1, 0, None)], None, False, 5.0)
    with pytest.raises(Exception, match="best of 3"):
        score.resumed(rows, states, 5).collect()
    with pytest.raises(Exception, match="goes back"):
        score.resumed(spark.createDataFrame([(1, 2, 4.0, "player_a")], SCHEMA), states, 3).collect()


def test_order_errors(spark):
    rows = [(1, 0, 1.0, "player_a"), (1, 1, 1.0, "player_a"), (1, 2, 0.5, "player_a"), (1, 3, 0.75, "player_b"), (2, 0, 0.0, "player_a")]
    assert [(r.match_id, r.seq, r.ts, r.before) for r in score.order_errors(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 2, 0.5, 1.0)]


def test_jumps_equal_the_fold(spark):
    rng = random.Random(5)
    rows = []
    for clip in range(6):
        t = 0.0
        for idx in range(rng.choice((1, 3, 60, 400))):
            t += rng.choice((0.0, 0.25, 0.5, 1.0, 20.0))
            rows.append((clip, idx, t, rng.choice((1.0, 9.0, 9.0, float("nan"), None))))
    s = spark.createDataFrame(rows, "clip long, idx long, t double, v double").repartition(5)
    for gap in (0.5, 2.0, 100.0):
        want = sorted(map(tuple, events.refractory(s, 9.0, gap).collect()))
        assert sorted(map(tuple, events.refractory_by_jumps(s, 9.0, gap).collect())) == want and want
    assert events.refractory_by_jumps(s.where("false"), 9.0, 1.0).count() == 0


def test_one_clip_is_spread_over_tasks(spark):
    s = spark.range(40_000).selectExpr("1L as clip", "id as idx", "id * 1.0D as t", "9.0D as v").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = events._hot(s, 9.0, "v")
        jumps = events._successors(hot, 3.0)
        assert jumps.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 2000).count() >= 4
        assert jumps.where("next = idx + 3").count() == jumps.count() == 39_996
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pointers_are_only_of_samples_at_which_a_range_is_entered(spark, monkeypatch):
    """Tables of the rounds grow with the ranges and what lies within a gap of their beginnings, not with the samples."""
    sizes, kept = {}, events.written

    def measured(spark, df, name):
        out = kept(spark, df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(events, "written", measured)
    rows = [(clip, idx, float(idx // 2 + clip), 9.0) for clip in (1, 2) for idx in range(6_000)]
    s = spark.createDataFrame(rows, "clip long, idx long, t double, v double").repartition(3)
    got = sorted(map(tuple, events.refractory_by_jumps(s, 9.0, 3.0).collect()))
    assert got == sorted(map(tuple, events.refractory(s, 9.0, 3.0).collect())) and len(got) > 1_900
    assert sizes["refractory-jumps"] < 400 and sizes["refractory-reached"] < 100


def test_a_load_is_published_whole_or_not_at_all(spark, tmp_path):
    root = f"{tmp_path}/table"
    good, bad = ([(1, 0, 0.0, "player_a"), (1, 1, 1.0, w)] for w in ("player_b", "nobody"))
    with pytest.raises(ValueError, match="nothing is published"):
        publish.published(spark, root)
    publish.publish(spark.createDataFrame(good, SCHEMA), root, score.load_errors)
    first = publish.published(spark, root)
    with pytest.raises(ValueError, match="Event 1: unknown winner nobody"):
        publish.publish(spark.createDataFrame(bad, SCHEMA), root, score.load_errors)
    # A writer that dies after its rows, or before the name is moved, changes nothing either.
    publish.staged(spark, spark.createDataFrame(bad, SCHEMA), root)
    assert sorted(map(tuple, publish.published(spark, root).collect())) == good
    publish.publish(spark.createDataFrame(good[:1], SCHEMA), root, score.load_errors)
    assert publish.published(spark, root).count() == 1
    assert first.count() == 2  # whoever reads the earlier version goes on with it


def test_any_json_document(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "points": [1, {"x": null}]\n}')
    (tmp_path / "b.json").write_text("no json")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in documents.read_json(spark, str(tmp_path)).selectExpr("path", "to_json(document) as text").collect()}
    assert got == {"a.json": '{"points":[1,{"x":null}]}', "b.json": None}
