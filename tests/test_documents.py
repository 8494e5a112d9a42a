"""Checks of events and documents, and the round trips of JSON sinks."""

import json
import os

import pytest
from cadentia.functions.scalars import shown_float
from cadentia.operators import evaluate, events, score
from cadentia.sources import documents, drafts
from pyspark.sql import functions as F

ROWS = [(1, 0, 3.0, "player_a"), (1, 1, 2.0, "player_b"), (2, 0, 1.0, "player_a"), (2, 1, None, "player_b"), (3, 0, 1.0, "nobody"), (4, 0, 1.0, None)]


def match_rows(spark, rows=ROWS):
    return spark.createDataFrame(rows, "match_id long, seq long, ts double, winner string")


def test_a_match_with_a_bad_event_is_not_loaded(spark):
    found = {r.match_id: (r.n_events, r.n_bad, r.loaded) for r in score.load_checks(match_rows(spark)).collect()}
    assert found == {1: (2, 0, True), 2: (2, 1, False), 3: (1, 1, False), 4: (1, 1, False)}
    assert {r.match_id for r in score.loaded_events(match_rows(spark)).collect()} == {1}
    assert score.load_checks(match_rows(spark).where("1 = 0")).count() == 0


def test_exported_events_come_back(spark, tmp_path):
    loaded = score.loaded_events(match_rows(spark))
    assert [(r.place, r.timestamp, r.winner) for r in score.exported(loaded).orderBy("place").collect()] == [(0, 2.0, "player_b"), (1, 3.0, "player_a")]
    documents.write_events(loaded, f"{tmp_path}/events")
    back = documents.read_events(spark, f"{tmp_path}/events")
    assert [(r.ts, r.winner) for r in back.orderBy("seq").collect()] == [(2.0, "player_b"), (3.0, "player_a")]
    assert score.timeline(back).count() == 2


def test_boxes_come_back(spark, tmp_path):
    documents.write_boxes(spark.createDataFrame([("c", 1, 2, 30, 40)], "clip string, x int, y int, w int, h int"), f"{tmp_path}/boxes")
    (tmp_path / "more.json").write_text('{"clip":"d","bbox":[5,6,7,8]}\n{"clip":"e"}\n')
    found = {r.clip: r.box and tuple(r.box) for r in documents.read_boxes(spark, [f"{tmp_path}/boxes", f"{tmp_path}/more.json"]).collect()}
    assert found == {"c": (1, 2, 30, 40), "d": (5, 6, 7, 8), "e": None}


def test_motion_documents(spark):
    found = spark.createDataFrame([("c", 2.0, "motion", 5.0), ("c", 1.0, "motion", 7.0)], "clip string, t double, kind string, value double")
    meta = spark.sql("select clip, named_struct('video', 'v.mp4', 'fps', 60.0D) as meta, named_struct('x', 1, 'y', 2) as roi from values ('c'), ('none') as t(clip)")
    got = {r.clip: json.loads(r.document) for r in documents.motion_documents(found, meta).collect()}
    assert [e["t"] for e in got["c"]["events"]] == [1.0, 2.0] and got["none"]["events"] == [] and got["c"]["meta"]["fps"] == 60.0


def draft(**changes):
    points = [{"id": "p1", "t_start": 0.0, "t_end": 2.0, "winner": "player_a", "confidence": 0.9}, {"id": "p2", "t_start": 5.0, "t_end": 8.0}]
    return {"schema_version": "1", "video_path": "v.mp4", "video_fps": 60.0, "roi": {"x": 1, "y": 2, "w": 3, "h": 4}, "points": points} | changes


@pytest.mark.parametrize("changes", [{"roi": {"x": 1, "y": 2, "w": 0, "h": 4}}, {"video_fps": 0.0}, {"points": [{"id": "p", "t_start": 3.0, "t_end": 3.0}]}])
def test_drafts_with_errors_are_not_written(spark, tmp_path, changes):
    for name, d in (("good", draft()), ("bad", draft(**changes))):
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    drafts.write_drafts(drafts.read_drafts(spark, f"{tmp_path}/good.json"), f"{tmp_path}/out")
    assert drafts.read_drafts(spark, f"{tmp_path}/good.json").count() == 1
    with pytest.raises(ValueError, match="ROI|fps|Point 0"):
        drafts.write_drafts(drafts.read_drafts(spark, f"{tmp_path}/bad.json"), f"{tmp_path}/refused")


def test_manifest_is_evaluated_and_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(draft()))
    (tmp_path / "b.json").write_text(json.dumps(draft(points=[{"id": "x", "t_start": 0.0, "t_end": 2.1, "winner": "player_b"}])))
    (tmp_path / "m.json").write_text(json.dumps({"pairs": [{"name": "same", "pred": f"{tmp_path}/a.json", "gt": f"{tmp_path}/a.json"}, {"pred": f"{tmp_path}/a.json", "gt": f"{tmp_path}/b.json"}]}))
    pred, gt = drafts.manifest_sides(spark, f"{tmp_path}/m.json")
    clips = evaluate.clip_metrics(pred, gt, evaluate.matched(evaluate.candidates(pred, gt, 0.5)))
    assert {r.clip: (r.tp, r.fp, r.fn) for r in clips.collect()} == {"same": (2, 0, 0), "a": (1, 1, 0)}
    documents.write_report(clips, evaluate.overall_metrics(clips), 0.5, f"{tmp_path}/report")
    line = spark.read.json(f"{tmp_path}/report/aggregate").first()
    assert line.clips == 2 and line.micro_detection.tp == 3 and spark.read.json(f"{tmp_path}/report/clips").count() == 2


@pytest.mark.parametrize("folder", ["plain", "with a blank", "a+b%20c", "ümlaut"])
def test_manifests_name_files_as_the_reference_does(spark, tmp_path, folder):
    """Relative to the working folder, absolute or as a URI, in folders of any name."""
    at = tmp_path / folder
    at.mkdir()
    (at / "a.json").write_text(json.dumps(draft()))
    (at / "b.json").write_text(json.dumps(draft(points=[{"id": "x", "t_start": 0.0, "t_end": 2.1}])))
    pairs = [{"pred": f"{at}/a.json", "gt": f"{at}/b.json"}, {"name": "uri", "pred": f"file://{at}/b.json", "gt": f"file:{at}/a.json"}]
    (tmp_path / "m.json").write_text(json.dumps({"pairs": pairs}))
    pred, gt = drafts.manifest_sides(spark, f"{tmp_path}/m.json")
    count = lambda df: {r.clip: r["count"] for r in df.groupBy("clip").count().collect()}
    assert count(pred) == {"a": 2, "uri": 1} and count(gt) == {"a": 1, "uri": 2}
    # The working folder is Spark's, which is fixed when it starts.
    base = spark._jvm.org.apache.hadoop.fs.Path(".").getFileSystem(spark._jsc.hadoopConfiguration()).getWorkingDirectory().toUri().getPath()
    (tmp_path / "r.json").write_text(json.dumps({"pairs": [{"pred": os.path.relpath(at / "a.json", base), "gt": os.path.relpath(at / "b.json", base)}]}))
    pred, gt = drafts.manifest_sides(spark, f"{tmp_path}/r.json")
    assert count(pred) == {"a": 2} and count(gt) == {"a": 1}


def test_manifests_with_missing_or_bad_files_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(draft()))
    (tmp_path / "bad.json").write_text(json.dumps(draft(roi=None)))
    for other, said in (("none.json", "PATH_NOT_FOUND"), ("bad.json", "Mandatory field 'roi'")):
        (tmp_path / "m.json").write_text(json.dumps({"pred": f"{tmp_path}/a.json", "gt": f"{tmp_path}/{other}"}))
        with pytest.raises(Exception, match=said):
            drafts.manifest_sides(spark, f"{tmp_path}/m.json")


def test_corrections_are_records(spark, tmp_path):
    changes = [{"at": "2024", "by": "ref", "changes": {"winner": {"from": "unknown", "to": "player_a"}, "t_end": {"to": 2.5}}, "note": "seen"}, {"changes": {"flags": ["x"]}}, {"at": "later"}]
    points = [{"id": "p", "t_start": 0.0, "t_end": 1.0, "corrections": changes}, {"id": "q", "t_start": 1.0, "t_end": 2.0}, {"id": "r", "t_start": 1.0, "t_end": 2.0, "corrections": []}]
    (tmp_path / "d.json").write_text(json.dumps(draft(points=points)))
    p = drafts.draft_points(drafts.read_drafts(spark, f"{tmp_path}/d.json"))
    assert [len(r.corrections or []) for r in p.orderBy("seq").collect()] == [3, 0, 0]
    rows = drafts.changed_fields(p).selectExpr("seq", "place", "at", "by", "note", "field", "to_json(value) as value").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, "2024", "ref", "seen", "t_end", '{"to":2.5}'), (0, 0, "2024", "ref", "seen", "winner", '{"from":"unknown","to":"player_a"}'), (0, 1, "", "", "", "flags", '["x"]')]


@pytest.mark.parametrize("x", [0.0, -1.0, 5.0, 12.25, 1e7, 123456789.5, 1704067798.778549, 9.9e15, 1e16, 1.5e22, 1e-3, 1e-4, 1.5e-5, 1e-300, -2.5e-7, 0.1 + 0.2])
def test_floats_are_shown_shortest(spark, x):
    assert spark.range(1).select(shown_float(F.lit(x))).first()[0] == repr(x)


def test_correction_outcomes(spark):
    rows = [("flip", "player_a")] * 3 + [("flip", "player_b")] + [("none", "player_a")] * 2 + [("none", "player_b")] * 2 + [("short", "player_a"), ("short", "unknown")]
    found = {r.clip: (r.delta_a, r.delta_b, r.n_unknown, r.outcome) for r in events.correction_outcomes(spark.createDataFrame(rows, "clip string, winner string"), 2, 2).collect()}
    assert found == {"flip": (-1, 1, 0, "flips"), "none": (0, 0, 0, "none"), "short": (1, 2, 1, "segmentation_error")}
