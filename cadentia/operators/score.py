"""Score replay: winner events folded into sets and matches.

A set is won at 11 points or more with two ahead, a match with more than half of the sets. Events after
that leave the score as it is. The fold streams over rows sorted by match and time, holding one match's
score, so the length of a match needs no memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAYERS = ("player_a", "player_b")
SET_POINTS, SET_LEAD = 11, 2


def needed_sets(best_of: int) -> int:
    if best_of <= 0 or best_of % 2 == 0:
        raise ValueError("best_of must be a positive odd number")
    return best_of // 2 + 1


@dataclass
class Score:
    """The score of one match."""

    best_of: int
    points: tuple[int, int] = (0, 0)
    sets: tuple[int, int] = (0, 0)
    number: int = 1
    winner: str | None = None
    last: float | None = None

    def add(self, ts: float, winner: str) -> tuple[int, int] | None:
        """Count an event; the points of the set that it closes, if it does. Bad events raise even after the end."""
        if winner not in PLAYERS:
            raise ValueError(f"unknown winner: {winner}")
        if self.last is not None and ts < self.last:
            raise ValueError(f"time goes back from {self.last} to {ts}")
        self.last = ts
        if self.winner:
            return None
        k = PLAYERS.index(winner)
        self.points = (self.points[0] + (k == 0), self.points[1] + (k == 1))
        if max(self.points) < SET_POINTS or abs(self.points[0] - self.points[1]) < SET_LEAD:
            return None
        closed, ahead = self.points, int(self.points[1] > self.points[0])
        self.sets = (self.sets[0] + (ahead == 0), self.sets[1] + (ahead == 1))
        if self.sets[ahead] >= needed_sets(self.best_of):
            self.winner = PLAYERS[ahead]
        else:
            self.points, self.number = (0, 0), self.number + 1
        return closed


def load_errors(events: DataFrame) -> DataFrame:
    """match_id, seq and message of events that a load refuses: without a time, or won by none of the players."""
    message = F.when(F.col("ts").isNull(), F.concat(F.lit("Event "), F.col("seq").cast("string"), F.lit(": no timestamp")))
    message = message.when(F.coalesce(~F.col("winner").isin(*PLAYERS), F.lit(True)), F.concat(F.lit("Event "), F.col("seq").cast("string"), F.lit(": unknown winner "), F.coalesce("winner", F.lit("null"))))
    return events.select("match_id", "seq", message.alias("message")).where("message is not null")


def load_checks(events: DataFrame) -> DataFrame:
    """match_id, n_events, n_bad and loaded: a match is loaded whole or, with any event that lacks a time or one of the players, not at all."""
    bad = F.col("ts").isNull() | F.coalesce(~F.col("winner").isin(*PLAYERS), F.lit(True))
    return events.groupBy("match_id").agg(F.count("*").alias("n_events"), F.count_if(bad).alias("n_bad")).withColumn("loaded", F.col("n_bad") == 0)


def loaded_events(events: DataFrame) -> DataFrame:
    """The events of matches that pass ``load_checks``."""
    return events.join(load_checks(events).where("loaded").select("match_id"), "match_id", "left_semi")


def exported(events: DataFrame) -> DataFrame:
    """match_id, place (from 0), timestamp and winner in the order in which a replay takes them."""
    order = Window.partitionBy("match_id").orderBy("ts", "seq")
    return events.select("match_id", (F.row_number().over(order) - 1).cast("long").alias("place"), F.col("ts").cast("double").alias("timestamp"), "winner")


SNAPSHOT = "match_id long, seq long, ts double, set_number int, score_a int, score_b int, sets_a int, sets_b int, is_finished boolean, winner string, closed_a int, closed_b int"
FINAL = "match_id long, n_events long, set_number int, score_a int, score_b int, sets_a int, sets_b int, is_finished boolean, winner string"
_FINAL_NAMES = [part.strip().split(" ")[0] for part in FINAL.split(",")]
_FINAL_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.bool_(), pa.string()]
_NAMES = [part.strip().split(" ")[0] for part in SNAPSHOT.split(",")]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 5, pa.bool_(), pa.string(), pa.int32(), pa.int32()]


def replay(events: DataFrame, best_of: int = 5, by_time: bool = True) -> DataFrame:
    """A snapshot after each of the events (match_id, seq, ts, winner), with the points of the set it closed.

    Events are taken in order of time, then seq; with ``by_time`` off in order of seq, and time going back is
    an error. A winner other than the two players is always one. The result is sorted within each match.
    """
    needed_sets(best_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, score = None, Score(best_of)
        for batch in batches:
            out = []
            for m, seq, ts, winner in zip(*(batch.column(c).to_pylist() for c in ("match_id", "seq", "ts", "winner")), strict=True):
                if m != match or match is None:
                    match, score = m, Score(best_of)
                closed = score.add(ts, winner) or (None, None)
                out.append((m, seq, ts, score.number, *score.points, *score.sets, score.winner is not None, score.winner, *closed))
            columns = zip(*out, strict=True) if out else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    order = ["match_id", "ts", "seq"] if by_time else ["match_id", "seq"]
    return events.select("match_id", "seq", "ts", "winner").repartition("match_id").sortWithinPartitions(*order).mapInArrow(run, SNAPSHOT)


def final_scores(events: DataFrame, best_of: int = 5) -> DataFrame:
    """The last snapshot of each match, and its number of events: the same fold as ``replay``, which gives out one row a match."""
    needed_sets(best_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, score, count = None, Score(best_of), 0

        def given(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(_FINAL_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FINAL_TYPES, strict=True)], names=_FINAL_NAMES)

        def last() -> tuple:
            return match, count, score.number, *score.points, *score.sets, score.winner is not None, score.winner

        for batch in batches:
            out = []
            for m, ts, winner in zip(*(batch.column(c).to_pylist() for c in ("match_id", "ts", "winner")), strict=True):
                if m != match or not count:
                    if count:
                        out.append(last())
                    match, score, count = m, Score(best_of), 0
                score.add(ts, winner)
                count += 1
            yield given(out)
        if count:
            yield given([last()])

    return events.select("match_id", "seq", "ts", "winner").repartition("match_id").sortWithinPartitions("match_id", "ts", "seq").mapInArrow(run, FINAL)


def timeline(events: DataFrame, best_of: int = 5, by_time: bool = True) -> DataFrame:
    return replay(events, best_of, by_time).drop("closed_a", "closed_b")


#: What a replay starts from: points of the open set, sets won, and the winner of a match that is over.
SEED = "match_id long, p_a int, p_b int, s_a int, s_b int, winner string, last_ts double"


def replay_by_sets(events: DataFrame, best_of: int = 5, seeds: DataFrame | None = None) -> DataFrame:
    """What ``replay`` returns, by windows over each match: at most ``best_of`` rounds, each of which finds where the next set ends.

    With running counts of both players' points, a set ends at the first event after the last end that has points and lead
    enough. All windows share one partitioning and order, so there is one exchange and no row passes through Python.
    ``seeds`` (see ``SEED``) has states to go on from; matches without one begin at the start. A winner other than the two players is an error,
    and so is an event before the time of its match's state.
    """
    need = needed_sets(best_of)
    rows = events.select("match_id", "seq", "ts", "winner")
    start = {"p_a": F.lit(0), "p_b": F.lit(0), "s_a": F.lit(0), "s_b": F.lit(0), "won": F.lit(None).cast("string"), "last_ts": F.lit(None).cast("double")}
    if seeds is None:
        rows = rows.select("*", *[c.alias(k) for k, c in start.items()])
    else:
        held = seeds.select("match_id", "p_a", "p_b", "s_a", "s_b", F.col("winner").alias("won"), "last_ts")
        rows = rows.join(held, "match_id", "left").select("match_id", "seq", "ts", "winner", *[F.coalesce(F.col(k), c).alias(k) for k, c in start.items()])
    match = Window.partitionBy("match_id")
    so_far = match.orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    is_a = F.when(F.col("winner") == PLAYERS[0], 1).when(F.col("winner") == PLAYERS[1], 0).otherwise(F.raise_error(F.concat(F.lit("unknown winner: "), F.coalesce("winner", F.lit("null")))))
    is_a = F.when(F.col("ts") < F.col("last_ts"), F.raise_error(F.lit("time goes back from the state of the match"))).otherwise(is_a)
    rows = rows.withColumn("is_a", is_a.cast("int"))
    # Points as if no set had ended, those of the state's open set included.
    rows = rows.select("*", F.row_number().over(match.orderBy("ts", "seq")).alias("rn"), F.sum("is_a").over(so_far).cast("int").alias("n_a"))
    rows = rows.withColumn("n_b", (F.col("rn") - F.col("n_a") + F.col("p_b")).cast("int")).withColumn("n_a", (F.col("n_a") + F.col("p_a")).cast("int"))
    ended = "struct<rn: int, n_a: int, n_b: int>"
    rows = rows.withColumns({"end0": F.when(F.col("won").isNull(), F.struct(F.lit(0).alias("rn"), F.lit(0).alias("n_a"), F.lit(0).alias("n_b"))).cast(ended), "a0": F.col("s_a"), "b0": F.col("s_b")})
    for k in range(1, best_of + 1):
        before = F.col(f"end{k - 1}")
        a, b = F.col("n_a") - before["n_a"], F.col("n_b") - before["n_b"]
        closes = (F.col("rn") > before["rn"]) & (F.greatest(a, b) >= SET_POINTS) & (F.abs(a - b) >= SET_LEAD)
        goes_on = (F.col(f"a{k - 1}") < need) & (F.col(f"b{k - 1}") < need)
        rows = rows.withColumn(f"end{k}", F.min(F.when(closes & goes_on, F.struct("rn", "n_a", "n_b"))).over(match))
        end = F.col(f"end{k}")
        by_a = (end["n_a"] - before["n_a"] > end["n_b"] - before["n_b"]).cast("int")
        rows = rows.withColumns({f"a{k}": F.when(end.isNull(), F.col(f"a{k - 1}")).otherwise(F.col(f"a{k - 1}") + by_a), f"b{k}": F.when(end.isNull(), F.col(f"b{k - 1}")).otherwise(F.col(f"b{k - 1}") + 1 - by_a)})
    # Per row: the last end up to it; a set that ends the match stays open to view.
    here, base, final, closed = [], F.col("end0"), F.lit(None).cast(ended), F.lit(None).cast("struct<a: int, b: int>")
    for k in range(1, best_of + 1):
        end, before = F.col(f"end{k}"), F.col(f"end{k - 1}")
        over = (F.col(f"a{k}") >= need) | (F.col(f"b{k}") >= need)
        reached = F.coalesce(end["rn"] <= F.col("rn"), F.lit(False))
        here.append((k, reached))
        base = F.when(reached & ~over, end).otherwise(base)
        final = F.when(reached & over, end).otherwise(final)
        closed = F.when(end["rn"] == F.col("rn"), F.struct((end["n_a"] - before["n_a"]).alias("a"), (end["n_b"] - before["n_b"]).alias("b"))).otherwise(closed)
    won_sets = lambda side, seed: reduce(lambda rest, k: F.when(k[1], F.col(f"{side}{k[0]}")).otherwise(rest), here, F.col(seed))
    rows = rows.select("match_id", "seq", "ts", "p_a", "p_b", "won", "n_a", "n_b", base.alias("base"), final.alias("final"), closed.alias("closed"), won_sets("a", "s_a").alias("sets_a"), won_sets("b", "s_b").alias("sets_b"))
    done = F.col("final").isNotNull() | F.col("won").isNotNull()
    score = lambda n, p: F.when(F.col("won").isNotNull(), F.col(p)).otherwise(F.coalesce(F.col("final")[n], F.col(n)) - F.col("base")[n]).cast("int")
    winner = F.coalesce("won", F.when(F.col("final").isNotNull(), F.when(F.col("sets_a") >= need, PLAYERS[0]).otherwise(PLAYERS[1])))
    return rows.select(
        "match_id", "seq", "ts", (F.col("sets_a") + F.col("sets_b") + F.when(done, 0).otherwise(1)).cast("int").alias("set_number"), score("n_a", "p_a").alias("score_a"), score("n_b", "p_b").alias("score_b"),
        F.col("sets_a").cast("int").alias("sets_a"), F.col("sets_b").cast("int").alias("sets_b"), done.alias("is_finished"), winner.alias("winner"), F.col("closed.a").alias("closed_a"), F.col("closed.b").alias("closed_b"),
    )


def set_results(events: DataFrame, best_of: int = 5) -> DataFrame:
    """match_id, set_no, points of both and the winner of each completed set."""
    closed = replay_by_sets(events, best_of).where("closed_a is not null")
    return closed.select("match_id", (F.col("sets_a") + F.col("sets_b")).alias("set_no"), F.col("closed_a").alias("points_a"), F.col("closed_b").alias("points_b"), F.when(F.col("closed_a") > F.col("closed_b"), PLAYERS[0]).otherwise(PLAYERS[1]).alias("set_winner"))


STATE_VERSION = "1.0"
STATES = "match_id long, schema_version string, best_of int, sets array<struct<player_a: int, player_b: int, winner: string>>, winner string, is_finished boolean, last_ts double"


def match_states(events: DataFrame, best_of: int = 5, states: DataFrame | None = None) -> DataFrame:
    """The state of each match after its events, as it is saved (see ``STATES``): all sets in order, the last one open unless the match is over.

    ``states`` has earlier ones that the events follow; those of matches without new events pass as they are.
    """
    rows = replay_by_sets(events, best_of, states and seeds_of(states, best_of))
    order = F.struct("ts", "seq")
    done = F.struct("ts", "seq", F.col("closed_a").alias("a"), F.col("closed_b").alias("b"))
    ended = rows.groupBy("match_id").agg(F.max_by(F.struct("score_a", "score_b", "is_finished", "winner", "ts"), order).alias("last"), F.array_sort(F.collect_list(F.when(F.col("closed_a").isNotNull(), done))).alias("closed"))
    by = lambda a, b: F.when(a > b, PLAYERS[0]).otherwise(PLAYERS[1])
    closed = F.transform("closed", lambda c: _set(c["a"], c["b"], by(c["a"], c["b"])))
    open_set = F.when(F.col("last.is_finished"), F.array().cast(f"array<{_SET}>")).otherwise(F.array(_set(F.col("last.score_a"), F.col("last.score_b"), F.lit(None))))
    if states is None:
        sets, kept = F.concat(closed, open_set), None
    else:
        ended = ended.join(states.select("match_id", F.filter("sets", lambda s: s["winner"].isNotNull()).alias("earlier"), F.col("is_finished").alias("was_over")), "match_id", "left")
        sets = F.concat(F.coalesce("earlier", F.array().cast(f"array<{_SET}>")), closed, open_set)
        kept = states.join(rows.select("match_id").distinct(), "match_id", "left_anti")
    out = ended.select("match_id", F.lit(STATE_VERSION).alias("schema_version"), F.lit(best_of).alias("best_of"), sets.alias("sets"), "last.winner", "last.is_finished", F.col("last.ts").alias("last_ts"))
    return out if kept is None else out.unionByName(kept.select(*out.columns))


def seeds_of(states: DataFrame, best_of: int) -> DataFrame:
    """What a replay goes on from, of saved states; the state of another kind of match is an error."""
    last = F.try_element_at("sets", F.lit(-1))
    won = lambda player: F.size(F.filter("sets", lambda s: s["winner"] == player))
    checked = F.when(F.col("best_of") == best_of, F.col("match_id")).otherwise(F.raise_error(F.concat(F.lit("a state of best of "), F.col("best_of").cast("string"))))
    points = lambda side: F.coalesce(last[side], F.lit(0)).alias(f"p_{side[-1]}")
    return states.select(checked.alias("match_id"), points("player_a"), points("player_b"), won(PLAYERS[0]).alias("s_a"), won(PLAYERS[1]).alias("s_b"), "winner", "last_ts")


def resumed(events: DataFrame, states: DataFrame, best_of: int = 5) -> DataFrame:
    """Snapshots after each of the events that follow saved states: what ``timeline`` of all events has for these."""
    return replay_by_sets(events, best_of, seeds_of(states, best_of)).drop("closed_a", "closed_b")


def order_errors(events: DataFrame) -> DataFrame:
    """match_id, seq, ts, before and message of events whose time lies before that of the event that came before, by seq. Equal times are none."""
    before = F.lag("ts").over(Window.partitionBy("match_id").orderBy("seq"))
    found = events.select("match_id", "seq", "ts", before.alias("before")).where("ts < before")
    return found.withColumn("message", F.lit("Event timestamp must be non-decreasing"))  # fixed value: the text of the error


_SET = "struct<player_a: int, player_b: int, winner: string>"


def _set(a: Column, b: Column, winner: Column) -> Column:
    return F.struct(a.alias("player_a"), b.alias("player_b"), winner.alias("winner")).cast(_SET)


def validated(all_events: DataFrame, best_of: int = 5, scope: str = "any", expected: str | None = None) -> DataFrame:
    """``validation_reports`` with the number of completed sets in place of the sets."""
    r = validation_reports(all_events, best_of, scope, expected)
    return r.withColumn("completed_sets", F.size("completed_sets").cast("long")).drop("expected_scope", "best_of", "open_set", "expected_final_set_score")


def validation_reports(all_events: DataFrame, best_of: int = 5, scope: str = "any", expected: str | None = None) -> DataFrame:
    """A report on each match: counts, sets, inferred score, issues and status. Events may have unknown winners.

    completed_sets holds player_a, player_b and winner of each set in order, open_set the same of the set being
    played, null once the match is over; both are bounded by ``best_of``. The inferred score is that of the last completed set, or of the open set while there is none. Status is
    pass; warn with any issue; fail if the scope (any, set or match) or the expected score is not met.
    """
    if scope not in ("any", "set", "match"):
        raise ValueError(f"unknown scope: {scope}")
    wanted = None
    if expected:
        parts = [p.strip() for p in expected.split("-")]
        if len(parts) != 2 or not all(p.isdigit() for p in parts):
            raise ValueError(f"not a score: {expected}")
        wanted = int(parts[0]), int(parts[1])
    counts = all_events.groupBy("match_id").agg(F.count("*").alias("event_count"), F.count_if(F.col("winner") == "unknown").alias("unknown_winner_count"))
    rows = replay(all_events.where("winner <> 'unknown'"), best_of)
    order = F.struct("ts", "seq")
    done = F.col("closed_a").isNotNull()
    state = rows.groupBy("match_id").agg(
        F.max_by(F.struct("score_a", "score_b", "is_finished", "winner"), order).alias("last"),
        F.array_sort(F.collect_list(F.when(done, F.struct("ts", "seq", "closed_a", "closed_b")))).alias("closed"),
    )
    r = counts.join(state, "match_id", "left").select(
        "match_id", "event_count", (F.col("event_count") - F.col("unknown_winner_count")).alias("known_winner_count"), "unknown_winner_count",
        F.coalesce("last.is_finished", F.lit(False)).alias("is_match_finished"), F.col("last.winner").alias("match_winner"),
        F.coalesce(F.transform("closed", lambda c: _set(c["closed_a"], c["closed_b"], F.when(c["closed_a"] > c["closed_b"], PLAYERS[0]).otherwise(PLAYERS[1]))), F.array().cast(f"array<{_SET}>")).alias("completed_sets"),
        F.when(F.coalesce(~F.col("last.is_finished"), F.lit(True)), _set(F.coalesce("last.score_a", F.lit(0)), F.coalesce("last.score_b", F.lit(0)), F.lit(None))).alias("open_set"),
    )
    final = F.coalesce(F.try_element_at("completed_sets", F.lit(-1)), F.col("open_set"))
    r = r.select("*", final["player_a"].alias("final_a"), final["player_b"].alias("final_b"))
    unmet = {"any": F.lit(False), "set": F.size("completed_sets") < 1, "match": ~F.col("is_match_finished")}[scope]
    # The texts of issues.
    said = {"any": "", "set": "Expected full set clip, but no completed set was detected.", "match": "Expected full match clip, but match is not finished."}[scope]
    shown = F.concat_ws("-", "final_a", "final_b")
    off = (F.col("final_a") != wanted[0]) | (F.col("final_b") != wanted[1]) if wanted else F.lit(False)
    issues = F.array_compact(
        F.array(
            F.when(F.col("known_winner_count") == 0, "No scored events available for validation."),
            F.when(F.col("unknown_winner_count") > 0, F.format_string("Unknown winners remaining: %d.", "unknown_winner_count")),
            F.when(unmet, said),
            F.when(off, F.concat(F.lit("Final set score mismatch: expected {}-{}, got ".format(*(wanted or (0, 0)))), shown, F.lit("."))),
        )
    )
    r = r.withColumns({"inferred_scoreline": shown, "issues": issues, "expected_scope": F.lit(scope), "best_of": F.lit(best_of), "expected_final_set_score": F.lit(expected).cast("string")})
    return r.withColumn("status", F.when(unmet | off, "fail").when(F.size("issues") > 0, "warn").otherwise("pass")).drop("final_a", "final_b")
