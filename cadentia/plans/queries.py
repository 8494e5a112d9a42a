"""One query for each operator over the driver's tables; ``oracles`` has SQL for the same rows."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.functions import boxes, scalars, sql
from cadentia.operators import consensus, evaluate, events, rectangles, score, segments, signal
from cadentia.plans import oracles
from cadentia.plans.rules import BOX_FORMS, CORRECTION_FORMS, GT_RULES, LEAST_IOU, RULES
from cadentia.sources import documents, drafts, publish, stream
from cadentia.sources.tables import epoch_micros, known_events, match_events, seconds, table, winner_of
from cadentia.sources.tables import signal as sampled
from cadentia.streaming import ordered, windows
from cadentia.streaming.replay import live_segments, live_timeline, table_and_fused

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return sampled(_events(spark, d))


def _conditioned(spark: SparkSession, d: str) -> DataFrame:
    return signal.conditioned(_signal(spark, d))


# Score


@query
def score_final(spark: SparkSession, d: str) -> DataFrame:
    return score.final_scores(known_events(_events(spark, d)), 3)


@query
def score_timeline(spark: SparkSession, d: str) -> DataFrame:
    return score.timeline(known_events(_events(spark, d)), 3)


@query
def score_timeline_bo5(spark: SparkSession, d: str) -> DataFrame:
    return score.timeline(known_events(_events(spark, d)), 5)


@query
def score_timeline_sets(spark: SparkSession, d: str) -> DataFrame:
    """The same timeline as score_timeline_bo5, set by set in windows."""
    return score.replay_by_sets(known_events(_events(spark, d)), 5).drop("closed_a", "closed_b")


@query
def score_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of the second half of January from states saved at its middle, as JSON, and read again."""
    events = known_events(_events(spark, d))
    middle = seconds(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    at = f"{stream.shared_dir(spark)}/states-{uuid.uuid4().hex}"
    documents.write_states(score.match_states(events.where(F.col("ts") < middle), 3), at)
    return score.resumed(events.where(F.col("ts") >= middle), documents.read_states(spark, at), 3)


@query
def match_states(spark: SparkSession, d: str) -> DataFrame:
    """The sets of each match after January, reached in two steps, as text."""
    events = known_events(_events(spark, d))
    middle = seconds(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    half = stream.written(spark, score.match_states(events.where(F.col("ts") < middle), 5), "states")
    states = score.match_states(events.where(F.col("ts") >= middle), 5, half)
    shown = F.concat_ws("|", F.transform("sets", lambda s: F.concat_ws("-", s["player_a"], s["player_b"], s["winner"])))
    return states.select("match_id", "best_of", shown.alias("sets"), "winner", "is_finished")


@query
def order_errors(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events of their customers' matches, in the order of their keys, whose dates go back."""
    return score.order_errors(table(spark, d, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("seq"), seconds(F.col("o_orderdate")).alias("ts")))


@query
def load_errors(spark: SparkSession, d: str) -> DataFrame:
    return score.load_errors(_mixed_events(spark, d))


@query
def published_events(spark: SparkSession, d: str) -> DataFrame:
    """What readers get after a load of known events and one of all events, which has unknown winners and so changes nothing."""
    root, events = f"{stream.shared_dir(spark)}/published-{uuid.uuid4().hex}", match_events(_events(spark, d))
    publish.publish(events.where("winner <> 'unknown'"), root, score.load_errors)
    with contextlib.suppress(ValueError):
        publish.publish(events, root, score.load_errors)
    return rounded(score.exported(publish.published(spark, root)), "timestamp")


@query
def set_results(spark: SparkSession, d: str) -> DataFrame:
    return score.set_results(known_events(_events(spark, d)), 3)


@query
def score_validation(spark: SparkSession, d: str) -> DataFrame:
    return score.validated(match_events(_events(spark, d)), 3, "match", "11-7").withColumn("issues", F.concat_ws("|", "issues"))


def _mixed_events(spark: SparkSession, d: str) -> DataFrame:
    """Match events in which only every third match has unknown winners."""
    e = match_events(_events(spark, d))
    return e.withColumn("winner", F.when((F.col("winner") == "unknown") & (F.col("match_id") % 3 != 0), "player_a").otherwise(F.col("winner")))


@query
def load_checks(spark: SparkSession, d: str) -> DataFrame:
    return score.load_checks(_mixed_events(spark, d))


@query
def exported_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(score.exported(score.loaded_events(_mixed_events(spark, d))), "timestamp")


@query
def score_validation_set(spark: SparkSession, d: str) -> DataFrame:
    """How many matches each status and issue has when a whole set is expected."""
    r = score.validated(match_events(_events(spark, d)), 3, "set")
    return r.groupBy("status", F.size("issues").cast("int").alias("n_issues")).agg(F.count("*").alias("matches"), F.sum("completed_sets").alias("completed_sets"))


@query
def score_reports(spark: SparkSession, d: str) -> DataFrame:
    """The sets in the report on each match, as text, and the status where any extent is right."""
    r = score.validation_reports(match_events(_events(spark, d)), 3)
    shown = lambda s: F.concat_ws("-", s["player_a"], s["player_b"], s["winner"])
    return r.select("match_id", "status", "best_of", "expected_scope", F.concat_ws("|", F.transform("completed_sets", shown)).alias("sets"), F.when(F.col("open_set").isNotNull(), shown(F.col("open_set"))).alias("open_set"))


@query
def winner_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda w: F.count_if(F.col("winner") == w)
    return match_events(_events(spark, d)).groupBy("match_id").agg(n("player_a").alias("wins_a"), n("player_b").alias("wins_b"), n("unknown").alias("unknown"))


@query
def unknown_policy(spark: SparkSession, d: str) -> DataFrame:
    return match_events(_events(spark, d)).select("match_id", "seq", scalars.resolved_winner(F.col("winner")).alias("final_winner"))


# Signal


@query
def signal_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.difference(_signal(spark, d)).select("clip", "idx", "diff"), "diff")


@query
def signal_sampled(spark: SparkSession, d: str) -> DataFrame:
    first = seconds(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    s = _signal(spark, d)
    return signal.strided(s.where((F.col("t") >= first) & (F.col("t") < first + 864000)), 3).select("clip", "idx", "v")


@query
def signal_fir_gauss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.gauss(_signal(spark, d)).select("clip", "idx", "smooth"), "smooth")


@query
def signal_fir_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.box(signal.box(_signal(spark, d), 7, out="box7"), 151, out="box151").select("clip", "idx", "box7", "box151"), "box7", "box151", digits=5)


@query
def signal_snr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.snr(_signal(spark, d)).select("clip", "idx", "snr"), "snr", digits=5)


@query
def signal_normalized(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_conditioned(spark, d).select("clip", "idx", "e"), "e")


# Segments


def _shown(s: DataFrame) -> DataFrame:
    return rounded(s, "t_start", "t_end")


@query
def segments_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return _shown(segments.hysteresis(_conditioned(spark, d), RULES))


@query
def segments_noflush(spark: SparkSession, d: str) -> DataFrame:
    return _shown(segments.hysteresis(_conditioned(spark, d), RULES, flush=False))


@query
def segments_split(spark: SparkSession, d: str) -> DataFrame:
    s = stream.written(spark, _conditioned(spark, d), "signal")
    return _shown(segments.split(s, segments.hysteresis(s, RULES), RULES).withColumn("flags", F.concat_ws("|", "flags")))


@query
def segments_split_sql(spark: SparkSession, d: str) -> DataFrame:
    """The same pieces by the table function."""
    sql.register(spark, RULES)
    s = stream.written(spark, _conditioned(spark, d), "signal")
    inside = segments.within(s, segments.hysteresis(s, RULES))
    inside.createOrReplaceTempView("samples_of_segments")
    pieces = spark.sql("SELECT * FROM split_segments(TABLE(samples_of_segments) PARTITION BY (clip, i_start) ORDER BY idx)")
    return _shown(pieces.withColumn("flags", F.concat_ws("|", "flags")))


@query
def segments_final(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_shown(segments.segmented(stream.written(spark, _conditioned(spark, d), "signal"), RULES).withColumn("flags", F.concat_ws("|", "flags"))), "confidence")


@query
def segments_fused(spark: SparkSession, d: str) -> DataFrame:
    s = _conditioned(spark, d).withColumn("near", F.col("idx") % 3 == 0).withColumn("other", F.least(F.col("v") / 100, F.lit(1.0)))
    return _shown(segments.hysteresis(signal.fused(s, "e", [("other", "near")], "x"), RULES, "x"))


@query
def motion_events(spark: SparkSession, d: str) -> DataFrame:
    found = events.refractory(_signal(spark, d), 40.0, 43200.0)
    return rounded(found.select("clip", "idx", "t", "value"), "t")


@query
def motion_events_by_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Motion events of all customers' values as one clip, in order of time, by pointer doubling."""
    e = _events(spark, d).select(F.lit(1).cast("long").alias("clip"), F.col("event_id").alias("idx"), seconds(F.col("ts")).alias("t"), F.col("value").alias("v"))
    found = events.refractory_by_jumps(e, 40.0, 600.0)
    return rounded(found.select("clip", "idx", "t", "value"), "t")


# Evaluation


def _numbered(s: DataFrame) -> DataFrame:
    order = Window.partitionBy("clip").orderBy("t_start")
    winner = F.when(F.col("i_start") % 3 == 0, "player_a").when(F.col("i_start") % 3 == 1, "player_b").otherwise("unknown")
    return s.select("clip", (F.row_number().over(order) - 1).cast("long").alias("seq"), "t_start", "t_end", winner.alias("winner"), F.round((F.col("i_end") - F.col("i_start")) % 10 / 10.0, 1).alias("confidence"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _conditioned(spark, d)
    return _numbered(segments.hysteresis(s, RULES)), _numbered(segments.hysteresis(s, GT_RULES))


@query
def iou_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.candidates(*_sides(spark, d), LEAST_IOU), "iou")


@query
def iou_matches(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.matched(evaluate.candidates(*_sides(spark, d), LEAST_IOU)), "iou")


@query
def unmatched_pred(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = _sides(spark, d)
    return evaluate.unmatched(pred, evaluate.matched(evaluate.candidates(pred, gt, LEAST_IOU)), "pi").select("clip", "seq")


@query
def unmatched_gt(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = _sides(spark, d)
    return evaluate.unmatched(gt, evaluate.matched(evaluate.candidates(pred, gt, LEAST_IOU)), "gi").select("clip", "seq")


def _clip_metrics(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = (stream.written(spark, side, "side") for side in _sides(spark, d))  # each is read three times
    return evaluate.clip_metrics(pred, gt, evaluate.matched(evaluate.candidates(pred, gt, LEAST_IOU)))


@query
def eval_clip(spark: SparkSession, d: str) -> DataFrame:
    rates = ["precision", "recall", "f1", "mean_iou", "winner_accuracy", "unknown_rate", "review_rate"]
    return rounded(_clip_metrics(spark, d).select("clip", "tp", "fp", "fn", *rates), *rates)


@query
def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.overall_metrics(_clip_metrics(spark, d))
    return rounded(m, *[c for c in m.columns if c.startswith("m")])


@query
def asof_state(spark: SparkSession, d: str) -> DataFrame:
    """The score of the customer's match at the time of each of the customer's orders."""
    states = score.timeline(known_events(_events(spark, d)), 3)
    asked = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("match_id"), seconds(F.col("o_orderdate")).alias("at"))
    extra = states.groupBy("match_id").agg(F.min("ts").alias("at")).select(F.lit(-1).cast("long").alias("o_orderkey"), "match_id", "at")
    middle = states.groupBy("match_id").agg(F.avg("ts").alias("at")).select(F.lit(-2).cast("long").alias("o_orderkey"), "match_id", F.floor("at").cast("double").alias("at"))
    lookups = asked.unionByName(extra).unionByName(middle)
    return evaluate.as_of(lookups, states, "match_id", "at", "ts", "seq", ["set_number", "score_a", "score_b", "sets_a", "sets_b"]).drop("at")


# Votes and points


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Orders as points: a clip for each customer, the winner from the status, the confidence from the price."""
    o = table(spark, d, "orders")
    winner = F.when(F.col("o_orderstatus") == "F", "player_a").when(F.col("o_orderstatus") == "O", "player_b").otherwise("unknown")
    start = seconds(F.col("o_orderdate"))
    return o.select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("seq"), start.alias("t_start"), (start + F.col("o_orderkey") % 7 * 60).alias("t_end"), winner.alias("winner"), F.round(F.col("o_orderkey") % 101 / 100.0, 2).alias("confidence"))


@query
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("vote"))
    return rounded(events.majority(votes, "item_id", "vote"), "consensus")


@query
def refine_points(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select(F.col("seq").alias("id"), "winner", "confidence", F.array().cast("array<string>").alias("flags"))
    votes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "A", "player_a").otherwise("player_b").alias("vote"))
    return rounded(events.refined(p, votes).withColumn("flags", F.concat_ws("|", "flags")), "confidence")


@query
def review_buckets(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    need = scalars.needs_review(F.col("winner"), F.col("confidence"))
    return p.groupBy(scalars.review_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("points"), F.count_if(need).alias("needing_review"))


@query
def flip_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return events.flip_suggestions(_points(spark, d).where("winner <> 'unknown'"), 6, 2)


@query
def correction_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return events.correction_outcomes(_points(spark, d), 6, 2)


@query
def document_errors(spark: SparkSession, d: str) -> DataFrame:
    """Checks of documents made of customers: the box's width and the frame rate from the key."""
    c = table(spark, d, "customer")
    roi = F.struct(*[F.lit("1").alias(k) for k in "xy"], (F.col("c_custkey") % 5 - 1).cast("string").alias("w"), F.lit("1").alias("h"))
    return drafts.document_errors(c.select(F.col("c_custkey").cast("string").alias("path"), (F.col("c_custkey") % 7).cast("double").alias("video_fps"), roi.alias("roi")))


@query
def draft_errors(spark: SparkSession, d: str) -> DataFrame:
    return drafts.point_errors(_points(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("clip").orderBy("seq")) - 1), "clip")


@query
def key_times(spark: SparkSession, d: str) -> DataFrame:
    """The three times at which a point is looked at: its middle, half a second before its end, its end."""
    p = _points(spark, d)
    times = F.array((F.col("t_start") + F.col("t_end")) / 2, F.col("t_end") - 0.5, F.col("t_end"))
    return p.select("clip", "seq", F.posexplode(times).alias("k", "at_time"))


# Boxes


FRAME_W, FRAME_H = 1280, 720


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes of one clip an order."""
    li = table(spark, d, "lineitem")
    n = lambda c, m, k: (F.col(c) * k % m).cast("int")
    size = F.col("l_quantity").cast("int")
    return li.select(
        F.col("l_orderkey").alias("clip"), ((F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias("seq"), n("l_partkey", 1400, 7).alias("x"), n("l_suppkey", 800, 11).alias("y"), (size * 9 + 20).alias("w"), (size * 3 + 10).alias("h"), F.round(F.col("l_discount") * 10, 2).alias("score")
    )


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


@query
def roi_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("clip", "seq", *boxes.clamped(*_c("x", "y", "w", "h"), F.lit(FRAME_W), F.lit(FRAME_H)))


@query
def play_zone(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("clip", "seq", *boxes.play_zone(*_c("x", "y", "w", "h"), F.lit(FRAME_W), F.lit(FRAME_H)))


@query
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each box with the next one of its clip."""
    order = Window.partitionBy("clip").orderBy("seq")
    b = _boxes(spark, d).select("*", *[F.lead(c).over(order).alias(f"n{c}") for c in "xywh"]).where("nx is not null")
    return rounded(b.select("clip", "seq", boxes.box_iou(*_c("x", "y", "w", "h", "nx", "ny", "nw", "nh")).alias("iou"), boxes.near_table(*_c("x", "w", "nx", "nw"), 100).alias("near")), "iou")


@query
def box_priors(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).where(boxes.large_enough(F.col("w"), F.col("h"), FRAME_W, FRAME_H))
    r = b.select("clip", "seq", boxes.aspect_prior(F.col("w"), F.col("h")).alias("aspect"), boxes.centre_prior(*_c("x", "y", "w", "h"), FRAME_W, FRAME_H).alias("centre"), boxes.area_confidence(F.col("w") * F.col("h") / F.lit(float(FRAME_W * FRAME_H))).alias("area"))
    return rounded(r, "aspect", "centre", "area")


@query
def box_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of boxes of other classes than persons, and their half-size widths."""
    b = _boxes(spark, d).where(boxes.kept_class(F.col("seq") % 4))
    centre, shape = boxes.centre_prior(*_c("x", "y", "w", "h"), FRAME_W, FRAME_H), boxes.aspect_prior(F.col("w"), F.col("h"))
    area = F.col("w") * F.col("h") / F.lit(float(FRAME_W * FRAME_H))
    r = b.select("clip", "seq", boxes.detection_rank(shape, centre, area, F.col("score")).alias("detection"), boxes.recovery_rank(shape, F.col("score"), centre).alias("recovery"), boxes.scaled(F.col("w"), 0.5).alias("half_w"))
    return rounded(r, "detection", "recovery")


@query
def sample_times(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select("event_id", F.posexplode(scalars.sample_times(F.col("value") - 5.0)).alias("k", "at_time")).select("event_id", "k", F.round("at_time", 6).alias("at_time"), scalars.is_low(F.col("at_time") / 100.0).alias("low"))


@query
def box_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_boxes(_boxes(spark, d), FRAME_W, FRAME_H)


@query
def recovered_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as detections that may be cut off at a side, and boxes of repaired searches that are wider by a part of them."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("clip"), seq.alias("seq")).agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")])  # numbers repeat
    n = lambda c, m, k: (F.col(c) * k % m).cast("int")
    w, h = (F.col("l_quantity") * 8 + 60).cast("int"), (F.col("l_quantity") * 3 + 20).cast("int")
    b = li.select("clip", "seq", n("l_partkey", 900, 7).alias("x"), n("l_suppkey", 600, 11).alias("y"), w.alias("w"), h.alias("h"), F.round(F.col("l_discount") * 5, 2).alias("score"), F.round(F.col("l_tax") * 5, 2).alias("left_score"), F.round(F.col("l_discount") * 4, 2).alias("right_score"))
    b = stream.written(spark, b.withColumns({"dx": F.col("x") - (F.col("seq") % 3 * 4).cast("int"), "dw": F.col("w") + (F.col("seq") % 5 * 4).cast("int")}), "detections")
    wider = (F.col("w") * (1 + F.col("seq") % 4) / 4).cast("int")
    score = F.round(F.col("score") - F.col("seq") % 3 * 0.03, 2)
    repairs = [b.select("clip", "seq", F.lit(side).alias("side"), x.cast("int").alias("x"), "y", (F.col("w") + wider).alias("w"), "h", score.alias("score")) for side, x in (("left", F.greatest(F.lit(0), F.col("x") - wider)), ("right", F.col("x")))]
    return rounded(consensus.recovered(b, repairs[0].unionByName(repairs[1]), FRAME_W, FRAME_H), "score")


@query
def roi_parse(spark: SparkSession, d: str) -> DataFrame:
    """JSON texts with the boxes of line items in every encoding, at several depths, and the boxes found in them."""
    b = _boxes(spark, d).withColumns({"r": F.col("x") + F.col("w"), "b": F.col("y") + F.col("h")})
    found = rectangles.find_boxes(b, _filled(BOX_FORMS, F.col("seq"), {k: F.col(k) for k in "xywhrb"}), ["clip", "seq", *"xywh"])  # numbers of items repeat
    return found.select("clip", "seq", *[F.col(f"box.{k}").alias(f"b{k}") for k in "xywh"])


def _filled(forms: list[str], number: Column, values: dict[str, Column]) -> Column:
    """One of the forms in turn, with its places filled."""
    text = F.element_at(F.array(*map(F.lit, forms)), (number % len(forms) + 1).cast("int"))
    for k, v in values.items():
        text = F.replace(text, F.lit("{" + k + "}"), v.cast("string"))
    return text


@query
def corrections(spark: SparkSession, d: str) -> DataFrame:
    """Changed fields in the corrections of orders as points, decoded from JSON texts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("seq"), _filled(CORRECTION_FORMS, F.col("o_orderkey"), {"key": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "day": F.col("o_orderkey") % 28 + 1}).alias("text"))
    points = o.select("path", "seq", F.from_json("text", drafts.CORRECTIONS).alias("corrections"))
    return drafts.changed_fields(points).select("path", "seq", "place", "at", "by", "note", "field", F.try_variant_get("value", "$.from", "string").alias("before"), F.try_variant_get("value", "$.to", "string").alias("after"))


@query
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field of the events' JSON, and how many have it, for each type."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.round(F.sum(k), 3).alias("sum_k"))


# Scalars


@query
def time_format(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select("event_id", scalars.minutes_seconds(F.col("value") * 60).alias("shown"), scalars.point_id(F.col("event_id")).alias("point_id"))


@query
def review_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """Points to review and overlaps of neighbouring ones, in SQL with the library's functions."""
    sql.register(spark)
    order = Window.partitionBy("clip").orderBy("t_start", "seq")
    _points(spark, d).withColumns({"n0": F.lead("t_start").over(order), "n1": F.lead("t_end").over(order)}).createOrReplaceTempView("points_in_sql")
    return spark.sql("""SELECT clip, seq, review_bucket(confidence) AS bucket, needs_review(winner, confidence) AS needs, point_id(seq) AS point_id, minutes_seconds(t_end - t_start) AS lasts,
      round(interval_iou(t_start, t_end, n0, n1), 6) AS iou, round(safe_divide(confidence, seq % 3), 6) AS part, label_of('it is ' || upper(winner)) AS label FROM points_in_sql""")


@query
def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("  The winner is "), F.when(F.col("event_id") % 3 == 0, "PLAYER_A ").when(F.col("event_id") % 3 == 1, "player_b, not player_a").otherwise("Player_B"), F.lit("."))
    text = F.when(F.col("event_id") % 5 == 0, "nobody").otherwise(text)
    return _events(spark, d).select("event_id", scalars.label_of(text).alias("label"))


@query
def parsed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Score pairs, frame rates and paths read from text."""
    e = _events(spark, d)
    pair = scalars.score_pair(F.concat(F.lit(" "), F.col("event_id") % 12, F.lit(" - "), F.col("user_id") % 12))
    rate = scalars.rational(F.concat_ws("/", F.col("event_id") % 60000, F.col("event_id") % 4))
    return e.select("event_id", pair["a"].alias("a"), pair["b"].alias("b"), F.round(rate, 6).alias("rate"), scalars.refined_path(F.concat(F.lit("m"), F.col("user_id"), F.lit("_draft.json"))).alias("path"), scalars.sets_required(F.col("event_id") % 4 * 2 + 1).alias("needed"))


# Sequences of other tables


@query
def nearest_two(spark: SparkSession, d: str) -> DataFrame:
    """The two boxes of a clip nearest to the centre of the frame."""
    x, y = F.col("x") + F.col("w") / 2 - FRAME_W / 2, F.col("y") + F.col("h") / 2 - FRAME_H / 2
    return events.nearest(_boxes(spark, d), ["clip"], x * x + y * y, 2, "seq").select("clip", "seq", "place", "distance")


@query
def wrist_speed(spark: SparkSession, d: str) -> DataFrame:
    """Speeds of two points given by the parts of each order's line items."""
    b = _boxes(spark, d).select("clip", (F.col("seq") % 2).alias("player"), F.col("seq").alias("idx"), (F.col("x") / 1000).alias("lx"), (F.col("y") / 1000).alias("ly"), (F.col("w") / 1000).alias("rx"), (F.col("h") / 1000).alias("ry"), (F.col("h") / 100.0).alias("height"))
    r = events.wrist_speed(b).select("clip", "player", "idx", "speed", scalars.compression_ratio(F.col("ly"), F.col("lx"), F.col("height")).alias("ratio"))
    return rounded(r, "speed")


@query
def player_slots(spark: SparkSession, d: str) -> DataFrame:
    """The first two suppliers of each order as its two players, 0 where there is none."""
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("clip"), "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    b = b.withColumn("k", F.row_number().over(Window.partitionBy("clip").orderBy("first", "l_suppkey")))
    slot = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("l_suppkey"))), F.lit(0)).alias(f"p{k}")
    return b.groupBy("clip").agg(slot(1), slot(2))


@query
def pooled_change(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute difference between each vector and the one before of its label."""
    e = table(spark, d, "embeddings")
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    change = F.aggregate(F.zip_with("embedding", before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x) / F.size("embedding")
    return rounded(e.select("vec_id", "label", change.alias("change")).where("change is not null"), "change")


@query
def turn_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Whether the turns of a conversation come in order and without gaps."""
    gap = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("gap", gap)
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("gap") != 1).alias("gaps"), F.max_by("role", "turn").alias("last_role"))


# Streams


@query
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    live = live_timeline(known_events(stream.table_stream(spark, d, "events")), 3)
    return stream.drained(spark, live, "stream-score")


@query
def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    e = stream.table_stream(spark, d, "events")
    samples = e.select(F.col("user_id").alias("clip"), seconds(F.col("ts")).alias("t"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("x"))
    return _shown(stream.drained(spark, live_segments(samples, RULES), "stream-segments"))


@query
def stream_machines(spark: SparkSession, d: str) -> DataFrame:
    """Live segments of one signal alone and of that fused with two others, each of which has a gate."""
    v = F.col("value")
    others = [F.least(v / by, F.lit(1.0)) for by in (80.0, 60.0)]
    gates = [F.floor(v) % n == 0 for n in (3, 4)]
    samples = stream.table_stream(spark, d, "events").select(F.col("user_id").alias("clip"), seconds(F.col("ts")).alias("t"), (v / 160).alias("table"), *[c.alias(f"p{i}") for i, c in enumerate(others)], *[c.alias(f"near{i}") for i, c in enumerate(gates)])
    return _shown(stream.drained(spark, table_and_fused(samples, RULES, GT_RULES, [("p0", "near0"), ("p1", "near1")]), "stream-machines"))


#: How far events come out of order in these streams, and the delay of their watermark: beyond that, a part of a stream, and how files of a part are dealt.
STREAM_PARTS, JITTER_S, DELAY, END_OF_TIME = 4, 86400, "10 days", "2100-01-01 00:00:00"


def _disordered(spark: SparkSession, d: str, columns: list[Column], held_back: Column | None = None) -> list[DataFrame]:
    """The events as parts of a stream in which they come up to a day early or late, then those held back, then an end mark (user -1).

    columns: what else the stream has than user_id, event_id and t (seconds).
    """
    e = _events(spark, d).select("user_id", "event_id", seconds(F.col("ts")).alias("t"), *columns)
    arrival = F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(JITTER_S))
    held = F.lit(False) if held_back is None else held_back
    first, last = (F.unix_timestamp(F.lit(x).cast("timestamp")) for x in ("2024-01-01 00:00:00", "2024-02-01 00:00:00"))
    part = F.least(F.greatest(F.floor((arrival - first) / (last - first) * STREAM_PARTS), F.lit(0)), F.lit(STREAM_PARTS - 1))
    e = e.withColumn("held", held).withColumn("part", F.when(F.col("held"), STREAM_PARTS).otherwise(part).cast("int"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), seconds(F.lit(END_OF_TIME).cast("timestamp_ntz")).alias("t"))
    parts = [e.where(F.col("part") == p).drop("part", "held") for p in range(STREAM_PARTS + (held_back is not None))]
    schema = parts[0].schema
    parts.append(end.select(*[F.col(f.name) if f.name in end.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))
    return parts


def _key_groups(spark: SparkSession, d: str) -> int:
    return ordered.groups_for(_events(spark, d).count())


@query
def stream_ordered_score(spark: SparkSession, d: str) -> DataFrame:
    """The score of events that come in any order; those of January's first half that are held back to the end are late."""
    held = (F.col("event_id") % 41 == 0) & (F.col("t") < seconds(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
    parts, groups = _disordered(spark, d, [winner_of(F.col("event_type")).alias("winner")], held), _key_groups(spark, d)

    def live(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("user_id").alias("match_id"), F.col("event_id").alias("seq"), F.col("t").alias("ts"), "winner").where("winner <> 'unknown' or winner is null")
        return ordered.ordered_timeline(rows, 3, DELAY, groups)

    with ordered.keyed_state(spark, groups):
        return stream.drained_in_turn(spark, parts, live, "ordered-score", settled=False)


@query
def stream_silent_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of samples that come in any order, closed by silence alone."""
    parts, groups = _disordered(spark, d, [F.least(F.col("value") / 100.0, F.lit(1.0)).alias("x")]), _key_groups(spark, d)

    def live(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("user_id").alias("clip"), F.col("event_id").alias("seq"), "t", "x")
        return ordered.ordered_segments(rows, RULES, DELAY, groups)

    with ordered.keyed_state(spark, groups):
        found = stream.drained_in_turn(spark, parts, live, "ordered-segments", settled=False)
    return _shown(found.where("not late").select("clip", "t_start", "t_end"))


def _windowed(spark: SparkSession, d: str, counts: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Counts of the disordered events, as a stream of user_id, at and winner."""

    def live(rows: DataFrame) -> DataFrame:
        return counts(rows.select("user_id", F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long")).alias("at"), "winner"))

    return stream.drained_in_turn(spark, _disordered(spark, d, [winner_of(F.col("event_type")).alias("winner")]), live, name)


@query
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Wins of each customer and day."""
    return _windowed(spark, d, lambda rows: windows.window_counts(rows, "user_id", "1 day", delay=DELAY), "tumbling")


@query
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Wins by two days, of which one begins each day."""
    return _windowed(spark, d, lambda rows: windows.window_counts(rows.withColumn("all", F.lit(0)), "all", "2 days", "1 day", DELAY), "sliding").drop("all")


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Wins of each customer in events that follow each other within eight hours."""
    return _windowed(spark, d, lambda rows: windows.session_counts(rows, "user_id", "8 hours", DELAY), "sessions")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: oracles.ORACLES[name] for name in QUERIES if name in oracles.ORACLES}
