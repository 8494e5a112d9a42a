"""Score replay on the scenarios of the domain's rules."""

import random

import pytest
from cadentia.operators import score
from cadentia.operators.score import Score

A, B = "player_a", "player_b"


def folded(winners, best_of=5):
    s = Score(best_of)
    closed = [s.add(float(i), w) for i, w in enumerate(winners)]
    return s, [c for c in closed if c]


def test_sets_and_deuce():
    s, closed = folded([A] * 11)
    assert (s.sets, s.points, s.number, closed) == ((1, 0), (0, 0), 2, [(11, 0)])
    s, _ = folded([A, B] * 10 + [A])
    assert (s.sets, s.points) == ((0, 0), (11, 10))
    s, closed = folded([A, B] * 10 + [A, B, A, A])
    assert (s.sets, closed) == ((1, 0), [(13, 11)])


@pytest.mark.parametrize(("best_of", "points"), [(1, 11), (3, 22), (5, 33), (7, 44)])
def test_match_ends_and_stays(best_of, points):
    s, _ = folded([B] * points, best_of)
    assert s.winner == B and s.points == (0, 11) and s.number == best_of // 2 + 1
    before = (s.points, s.sets, s.number)
    assert s.add(999.0, A) is None and (s.points, s.sets, s.number) == before
    with pytest.raises(ValueError):
        s.add(1.0, A)
    with pytest.raises(ValueError):
        s.add(1000.0, "nobody")


@pytest.mark.parametrize("best_of", [0, -1, 2, 4])
def test_bad_best_of(best_of):
    with pytest.raises(ValueError):
        score.needed_sets(best_of)


def test_random_matches_end():
    rng = random.Random(4)
    for _ in range(50):
        s = Score(5)
        for i in range(2000):
            s.add(float(i), rng.choice((A, B)))
        assert s.winner and max(s.sets) == 3


def rows(spark, winners, match=1, times=None):
    return spark.createDataFrame([(match, i, float(times[i] if times else i), w) for i, w in enumerate(winners)], "match_id long, seq long, ts double, winner string")


def test_replay_over_matches(spark):
    e = rows(spark, [A] * 33 + [B] * 20, 1).union(rows(spark, [B] * 5, 2)).union(rows(spark, [A, B], 3, [5, 5]))
    t = score.timeline(e).collect()
    last = {r.match_id: r for r in sorted(t, key=lambda r: (r.ts, r.seq))}
    assert len(t) == 60 and last[1].is_finished and last[1].winner == A and last[1].ts == 52.0 and (last[1].score_a, last[1].score_b) == (11, 0)
    assert (last[2].score_b, last[2].set_number, last[3].score_a, last[3].score_b) == (5, 1, 1, 1)
    assert score.set_results(e).count() == 3 and score.final_scores(e).count() == 3


def test_replay_order(spark):
    back = rows(spark, [A, B], times=[5, 1])
    assert [r.seq for r in sorted(score.timeline(back).collect(), key=lambda r: r.ts)] == [1, 0]
    with pytest.raises(Exception, match="time goes back"):
        score.timeline(back, by_time=False).collect()
    with pytest.raises(Exception, match="unknown winner"):
        score.timeline(rows(spark, [A, "unknown"])).collect()


def test_validation(spark):
    e = rows(spark, [A] * 11, 1).union(rows(spark, ["unknown"], 2)).union(rows(spark, [A] * 3 + ["unknown"], 3))
    got = {r.match_id: r for r in score.validated(e, 5, "set", "11-0").collect()}
    assert (got[1].status, got[1].inferred_scoreline, got[1].issues) == ("pass", "11-0", [])
    assert got[2].status == "fail" and got[2].inferred_scoreline == "0-0" and len(got[2].issues) == 4
    assert got[3].status == "fail" and got[3].inferred_scoreline == "3-0"
    assert {r.match_id: r.status for r in score.validated(e, 5).collect()} == {1: "pass", 2: "warn", 3: "warn"}
    for scope, expected in (("game", None), ("any", "11"), ("any", "a-b")):
        with pytest.raises(ValueError):
            score.validated(e, 5, scope, expected)
