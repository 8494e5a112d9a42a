"""Overlap join and matching against loops over all pairs."""

import random

import pytest
from cadentia.operators import evaluate


def intervals(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.choice((0.0, -7.0, 1.7e9)) + rng.randint(0, 60) / 2
        out.append((rng.choice((1, 1, 1, 2)), i, t, t + rng.choice((0.0, 0.5, 1.0, 2.0, 3.0, 8.0, 40.0))))
    return out


def iou(p, g):
    overlap = max(0.0, min(p[3], g[3]) - max(p[2], g[2]))
    return overlap / (max(p[3], g[3]) - min(p[2], g[2])) if overlap else 0.0


def greedy(pairs):
    out, used = [], set()
    for x, clip, p, g in sorted((-x, clip, p, g) for clip, p, g, x in pairs):
        if not {(clip, "p", p), (clip, "g", g)} & used:
            used |= {(clip, "p", p), (clip, "g", g)}
            out.append((clip, p, g, round(-x, 9)))
    return sorted(out)


@pytest.mark.parametrize("least", [0.05, 0.5, 1.0])
def test_candidates_and_matches(spark, least):
    pred, gt = intervals(220, 1), intervals(180, 2)
    schema = "clip long, seq long, t_start double, t_end double"
    found = evaluate.candidates(spark.createDataFrame(pred, schema), spark.createDataFrame(gt, schema), least)
    want = [(p[0], p[1], g[1], iou(p, g)) for p in pred for g in gt if p[0] == g[0] and iou(p, g) >= least]
    assert sorted((r.clip, r.pi, r.gi) for r in found.collect()) == sorted(w[:3] for w in want) and want
    assert sorted((r.clip, r.pi, r.gi, round(r.iou, 9)) for r in evaluate.matched(found).collect()) == greedy(want)


def test_one_large_clip(spark):
    rows = spark.range(60_000).selectExpr("1L as clip", "id as seq", "id * 2.0D as t_start", "id * 2.0D + 1.5D as t_end")
    join = evaluate.candidates(rows, rows)
    # By clip and bin: the join has more keys than the clip, and a clip isn't folded in one row.
    assert "g_bin" in join._jdf.queryExecution().toString()
    assert evaluate.matched(join).where("pi = gi").count() == 60_000


def test_chain_of_rounds(spark):
    pairs = [(1, i, i, 0.5 + i / 100) for i in range(6)] + [(1, i, i + 1, 0.505 + i / 100) for i in range(6)]
    found = evaluate.matched(spark.createDataFrame(pairs, "clip long, pi long, gi long, iou double")).collect()
    assert sorted((r.clip, r.pi, r.gi, round(r.iou, 9)) for r in found) == greedy(pairs)
