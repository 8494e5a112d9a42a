"""Recovery of boxes that a detector cut off, against a loop over the candidates of each."""

import math
import random

from cadentia.operators import consensus

W, H = 1280, 720


def shape(b):
    return math.exp(-((((b[2] / max(1.0, b[3])) - 3.2) / 0.85) ** 2))


def centre(b):
    dx, dy = ((b[0] + b[2] / 2) / W - 0.5) / 0.35, ((b[1] + b[3] / 2) / H - 0.55) / 0.28
    left, right = b[0] / W, (b[0] + b[2]) / W
    edge = 0.20 if left < 0.03 or right > 0.97 else 0.55 if left < 0.06 or right > 0.94 else 1.0
    return min(1.0, max(0.0, math.exp(-(dx * dx + dy * dy)) * edge))


def choose(d, offers):
    box, score, dx, dw, left_score, right_score = d
    aspect = box[2] / max(1.0, box[3])
    slack = max(6, int(dw * 0.02))
    at_left, at_right = abs(box[0] - dx) <= slack, abs(box[0] + box[2] - dx - dw) <= slack
    sides = set()
    if aspect < 2.95:
        if at_left and at_right:
            sides = {"left"} if left_score > right_score * 1.1 else {"right"} if right_score > left_score * 1.1 else {"left", "right"}
        else:
            sides = {"left"} if at_left else {"right"} if at_right else set()
    best, rank = (box, score, None), shape(box) * 0.55 + score * 0.2 + centre(box) * 0.25
    for side in ("left", "right"):
        if side in sides and side in offers:
            b, s = offers[side]
            r = shape(b) * 0.55 + s * 0.2 + centre(b) * 0.25
            if b[2] / max(1.0, b[3]) > max(2.95, aspect + 0.2) and shape(b) >= shape(box) + 0.08 and s >= score - 0.04 and r > rank:
                best, rank = (b, s, side), r
    return best


def test_recovery_against_a_loop(spark):
    rng = random.Random(9)
    detections, repairs, want = [], [], {}
    for k in range(600):
        h = rng.randint(0, 120)
        box = (rng.randint(0, 900), rng.randint(0, 600), rng.randint(40, 400), h)
        d = (box, rng.randint(0, 100) / 100, box[0] - rng.choice((0, 5, 6, 7, 40)), box[2] + rng.choice((0, 6, 12, 60)), rng.randint(0, 10) / 10, rng.randint(0, 10) / 10)
        offers = {}
        for side in ("left", "right"):
            if rng.random() < 0.8:
                more = rng.randint(0, 250)
                offers[side] = ((max(0, box[0] - more) if side == "left" else box[0], box[1], box[2] + more, h), d[1] - rng.choice((0.0, 0.03, 0.05, -0.1)))
                repairs.append((1, k, side, *offers[side][0], offers[side][1]))
        detections.append((1, k, *box, *d[1:]))
        want[k] = choose(d, offers)
    rows = consensus.recovered(
        spark.createDataFrame(detections, "clip long, seq long, x int, y int, w int, h int, score double, dx int, dw int, left_score double, right_score double"),
        spark.createDataFrame(repairs, "clip long, seq long, side string, x int, y int, w int, h int, score double"), W, H,
    )
    got = {r.seq: ((r.x, r.y, r.w, r.h), r.score, r.side) for r in rows.collect()}
    assert got == want and {w[2] for w in want.values()} == {None, "left", "right"}


def test_repairs_that_mirror_each_other_rank_as_the_c_library_has_it(spark):
    """Left and right repairs at one distance from the centre, whose ranks differ by rounding alone, as ``exp`` of databases and of Python gives them."""
    detections, repairs, want = [], [], {}
    for k in range(600):
        box = (466, k, 348, 128)
        offers = {"left": ((379, k, 435, 128), 0.25), "right": ((466, k, 435, 128), 0.25)}
        detections.append((1, k, *box, 0.25, 466, 348, 0.2, 0.2))
        repairs += [(1, k, side, *b, s) for side, (b, s) in offers.items()]
        want[k] = choose((box, 0.25, 466, 348, 0.2, 0.2), offers)
    rows = consensus.recovered(
        spark.createDataFrame(detections, "clip long, seq long, x int, y int, w int, h int, score double, dx int, dw int, left_score double, right_score double"),
        spark.createDataFrame(repairs, "clip long, seq long, side string, x int, y int, w int, h int, score double"), W, H,
    )
    assert {r.seq: ((r.x, r.y, r.w, r.h), r.score, r.side) for r in rows.collect()} == want and {w[2] for w in want.values()} >= {"left", "right"}
