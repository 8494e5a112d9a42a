"""Small functions, matching, votes and documents."""

import json

import pytest
from cadentia.functions import boxes, scalars
from cadentia.operators import evaluate, events, rectangles
from cadentia.sources import drafts
from pyspark.sql import functions as F


BOXES = [
    ('{"x":1,"y":2,"w":3,"h":4}', (1, 2, 3, 4)), ('{"x":0.5,"y":1.5,"width":2.5,"height":"4"}', (0, 2, 2, 4)), ('{"left":1,"top":2,"right":5,"bottom":9}', (1, 2, 4, 7)), ('{"left":1,"top":2,"width":5,"height":9}', (1, 2, 5, 9)),
    ('{"l":1,"t":2,"r":5,"b":9}', (1, 2, 4, 7)), ("[10,20,5,0]", None), ("[1,2,5,-1]", None), ("[5,6,4,9]", (5, 6, 4, 9)), ("[10,20,30,0]", None), ("[5,6,-4,9]", None), ("[5,6,7,null]", None), ('{"x1":1,"y1":1,"x2":3,"y2":4}', (1, 1, 2, 3)),
    ('{"x":1,"y":2,"w":0,"h":4,"roi":[1,2,3,4]}', None), ('{"x":null,"y":1,"w":2,"h":3}', None), ('{"x":null,"y":1,"w":2,"h":3,"roi":[1,2,3,4]}', None), ('{"x":1e30,"y":1,"w":2,"h":3}', None), ('{"x":"NaN","y":1,"w":2,"h":3}', None),
    ('{"points":[[1,2],[5,2],["a",9],{"x":3,"y":7}]}', (1, 2, 4, 7)), ('{"points":[[1,2]],"poly":[[0,0],[2,2]]}', (0, 0, 2, 2)), ('{"points":[[1,2]],"area":[0,0,2,2]}', (0, 0, 2, 2)), ('{"polygon":"none","vertices":[{"x":"1","y":1},{"x":4,"y":3},[]]}', (1, 1, 3, 2)),
    ('{"table":{"bbox":[1,2,3,4]}}', (1, 2, 3, 4)), ('{"roi":{"q":1},"rect":[0,0,2,2]}', (0, 0, 2, 2)), ('{"roi":{"x":1,"y":2,"w":-3,"h":4,"bbox":[1,2,3,4]}}', None), ('{"roi":{"x":1,"y":2,"w":-3,"h":4},"q":[1,2,3,4]}', (1, 2, 3, 4)),
    ('{"z":[9,9,9,9],"a":[1,1,1,1],"bbox":{"deep":{"deeper":{"deepest":{"l":0,"t":0,"r":2,"b":2}}}}}', (0, 0, 2, 2)), ('{"z":[9,9,9,9],"a":[1,1,1,1]}', (9, 9, 9, 9)), ('{"foo":{"x":1,"y":2,"w":3,"h":4}}', (1, 2, 3, 4)),
    ('{"z":{"y":{"x":[3,3,3,3]}},"a":[1,1,1,1]}', (3, 3, 3, 3)), ('{"a":"{\\"x\\":1,\\"y\\":2,\\"w\\":3,\\"h\\":4}"}', None), ('{"a":[[1,2,3,4]]}', None), ('{"a":' * 30 + "[1,2,3,4]" + "}" * 30, (1, 2, 3, 4)),
    ("nonsense", None), ('{"x":1,', None), ("[1,2,3]", None), ("", None), ("7", None), (None, None),
]


def test_boxes_at_any_depth(spark):
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(BOXES)], "k long, j string")
    got = {r.k: r.box and tuple(r.box) for r in rectangles.find_boxes(rows, F.col("j"), ["k"]).collect()}
    assert got == {k: box for k, (_, box) in enumerate(BOXES)}


def test_boxes_are_found_where_the_texts_lie(spark):
    """No table is written and no row moves, however deep the texts are; odd texts end no job."""
    odd = [
        ('{"left":-2000000000,"top":0,"right":2000000000,"bottom":5}', None), ("\n[1,2,3,4]\t", (1, 2, 3, 4)), ("[1,2,3,4] x", None), ("{'x':1,'y':2,'w':3,'h':4}", None), ('{"x":2147483647.5,"y":1,"w":3,"h":4}', None),
        ('{"x":true,"y":" 2.5 ","w":"3e0","h":4}', (1, 2, 3, 4)), ('{"x":"1_0","y":1,"w":3,"h":4}', None), ('{"x":' + "1" * 5000 + ',"y":1,"w":3,"h":4}', None), ('{"a":' * 900 + "[1,2,3,4]" + "}" * 900, (1, 2, 3, 4)), ('{"a":' * 200_000, None),
    ]
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(odd)], "k long, j string")
    found = rectangles.find_boxes(rows, F.col("j"), ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "FileScan" not in plan
    assert {r.k: r.box and tuple(r.box) for r in found.collect()} == {k: box for k, (_, box) in enumerate(odd)}


def test_near_table_looks_sideways_only(spark):
    rows = spark.createDataFrame([(0, 10), (640, 10), (-60, 10), (660, 10), (-261, 10), (1, 1)], "x int, w int")
    assert [r.n for r in rows.select(boxes.near_table(F.col("x"), F.col("w"), F.lit(100), F.lit(300)).alias("n")).collect()] == [True, True, True, False, False, True]


def test_scalars(spark):
    d = spark.createDataFrame([(3725.9, " 11 - 7 ", "30000/1001", 5)], "t double, s string, r string, n int")
    r = d.select(scalars.minutes_seconds(F.col("t")).alias("m"), scalars.score_pair(F.col("s")).alias("p"), scalars.rational(F.col("r")).alias("r"), scalars.rational(F.lit("1/0")).alias("z"), scalars.rational(F.lit("x")).alias("x"), scalars.sets_required(F.col("n")).alias("q")).first()
    assert (r.m, tuple(r.p), round(r.r, 3), r.z, r.x, r.q) == ("62:05", (11, 7), 29.97, 30.0, 30.0, 3)
    with pytest.raises(Exception, match="not a score"):
        d.select(scalars.score_pair(F.col("r"))).collect()
    with pytest.raises(Exception, match="odd"):
        d.select(scalars.sets_required(F.col("n") - 1)).collect()


def test_votes(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b")], "id long, vote string")
    got = {r.id: (r.winner, round(r.consensus, 3)) for r in events.majority(v, "id", "vote").collect()}
    assert got == {1: ("a", 0.667), 2: ("unknown", 0.0), 3: ("b", 1.0)}
    p = spark.createDataFrame([(1, "unknown", 0.1, []), (2, "unknown", 0.1, ["winner_low_consensus"]), (3, "a", 0.1, []), (4, "unknown", 0.1, [])], "id long, winner string, confidence double, flags array<string>")
    r = {x.id: (x.winner, round(x.confidence, 2), x.flags) for x in events.refined(p, v).collect()}
    assert r == {1: ("a", 0.67, ["winner_low_consensus"]), 2: ("unknown", 0.1, ["winner_low_consensus"]), 3: ("a", 0.1, []), 4: ("unknown", 0.1, [])}


def test_refractory(spark):
    s = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate([9.0, 9.0, 9.0, 1.0, 9.0, 9.0])] + [(2, 0, 0.0, 9.0)], "clip long, idx long, t double, v double")
    assert sorted((r.clip, r.idx) for r in events.refractory(s, 9, 2).collect()) == [(1, 1), (1, 4)]


def test_matching_is_greedy(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 16.0), (1, 2, 50.0, 51.0)], "clip long, seq long, t_start double, t_end double")
    g = spark.createDataFrame([(1, 0, 4.0, 16.0), (1, 1, 0.0, 5.0)], "clip long, seq long, t_start double, t_end double")
    pairs = evaluate.candidates(p, g, 0.3)
    assert sorted((r.pi, r.gi) for r in pairs.collect()) == [(0, 0), (0, 1), (1, 0)]
    m = evaluate.matched(pairs)
    assert sorted((r.pi, r.gi) for r in m.collect()) == [(0, 1), (1, 0)]
    assert [r.seq for r in evaluate.unmatched(p, m, "pi").collect()] == [2]
    assert evaluate.candidates(p, g, 0.0).count() == 6


def test_as_of(spark):
    states = spark.createDataFrame([(1, 5.0, 1, "x"), (1, 5.0, 2, "y"), (1, 9.0, 3, "z")], "k long, ts double, seq long, v string")
    asked = spark.createDataFrame([(1, 4.9), (1, 5.0), (1, 8.0), (1, 100.0), (2, 5.0)], "k long, at double")
    got = {(r.k, r["at"]): r.v for r in evaluate.as_of(asked, states, "k", "at", "ts", "seq", ["v"]).collect()}
    assert got == {(1, 4.9): None, (1, 5.0): "y", (1, 8.0): "y", (1, 100.0): "z", (2, 5.0): None}


def test_drafts(spark, tmp_path):
    good = {"schema_version": "1", "video_path": "v", "video_fps": 60.0, "roi": {"x": 1, "y": 2, "w": 3, "h": 4}, "points": [{"id": "a", "t_start": 0.0, "t_end": 1.0, "winner": "player_a"}, {"id": "b", "t_start": 5.0, "t_end": 2.0}, {"id": "c", "t_start": 1.0, "t_end": 3.0}]}
    bad = {**good, "video_fps": None, "roi": {"x": 1.5, "y": 2, "w": 3}}
    for name, d in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1))
    d = drafts.strict_errors(drafts.read_drafts(spark, str(tmp_path)))
    errors = {r.path.rsplit("/", 1)[1]: r.strict_errors for r in d.collect()}
    assert errors["good.json"] == [] and len(errors["bad.json"]) == 3
    p = drafts.draft_points(d.where("path like '%good%'"))
    assert sorted((r.seq, r.winner, r.best_of) for r in p.collect()) == [(0, "player_a", 5), (1, "unknown", 5), (2, "unknown", 5)]
    assert sorted(r.message for r in drafts.point_errors(p).collect()) == ["Point 1: Invalid time range (5.0 -> 2.0)", "Point 2: Non-monotonic timestamps (start before previous end)"]
    assert drafts.score_events(p).count() == 1
    with pytest.raises(ValueError):
        drafts.write_drafts(d.drop("strict_errors"), str(tmp_path / "out"))
    # Points out of order are errors as well; test_documents has drafts that are written.
    with pytest.raises(ValueError, match="Point 1: Invalid time range"):
        drafts.write_drafts(d.where("path like '%good%'").drop("strict_errors"), str(tmp_path / "out"))
    (tmp_path / "m.json").write_text(json.dumps({"pairs": [{"pred": "a/b/clip1.json", "gt": "g"}, {"name": "n", "pred": "p", "gt": "q"}]}))
    assert sorted(r.name for r in drafts.read_manifest(spark, str(tmp_path / "m.json")).collect()) == ["clip1", "n"]
