"""Live operators for rows that come late or in any order: score and segments in the order of event time.

Rows of a key wait in a state until the watermark passes their time; event-time timers then hand them to the
key's machine in order, whatever batches they came in. A row that comes when the watermark has passed it already is
late: it changes nothing and goes out as a row of its own kind. The same timers close a segment whose signal falls silent, without
a later sample.

Calls of Spark and of its state cost some milliseconds each, so keys share them in groups, by hash: a group has one list of rows that wait,
one value with the machines of its keys and one timer. What waits for a group is what comes within the delay of the watermark; streams of more rows
need more groups (``groups_for``). A partition of the state costs up to a second of a core in each micro-batch, even if it is empty, so partitions follow the groups
as well (``keyed_state``). State is kept in RocksDB, on the executors' disks with
copies in the checkpoint folder, so a lost executor's keys go on elsewhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadentia.operators.score import Score, needed_sets
from cadentia.operators.segments import Rules
from cadentia.sources import stream

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"

#: Groups of keys by default, rows of a stream for each group where their number is known, groups for each partition of the state, and rows of each frame given out.
GROUPS, GROUP_ROWS, PARTITION_GROUPS, FRAME_ROWS = 256, 8_192, 32, 10_000


def groups_for(rows: int) -> int:
    """Groups of keys for a stream of about so many rows."""
    return max(16, rows // GROUP_ROWS)


@contextmanager
def keyed_state(spark: SparkSession, groups: int | None = None) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which lists and timers need.

    With ``groups``, a new stream has no more partitions than these need and cores are there for, and never more than the session's; a
    stream that goes on from a checkpoint keeps those it has.
    """
    conf = {_PROVIDER: _ROCKSDB}
    if groups is not None:
        needed = max(spark.sparkContext.defaultParallelism, -(-groups // PARTITION_GROUPS))
        conf[_PARTITIONS] = str(min(int(spark.conf.get(_PARTITIONS)), needed))
    with stream.configured(spark, conf):
        yield


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("long")


class ScoreMachine:
    """The score of one match, fed in order."""

    state = "p_a int, p_b int, s_a int, s_b int, number int, winner string, last double"

    def __init__(self, best_of: int, held: tuple | None):
        p_a, p_b, s_a, s_b, number, winner, last = held or (0, 0, 0, 0, 1, None, None)
        self.score = Score(best_of, (p_a, p_b), (s_a, s_b), number, winner, last)

    def take(self, at: int, seq: int, ts: float, winner: str) -> list[tuple]:
        self.score.add(ts, winner)
        s = self.score
        return [(seq, ts, False, s.number, *s.points, *s.sets, s.winner is not None, s.winner)]

    def late(self, at: int, seq: int, ts: float, winner: str) -> tuple:
        return (seq, ts, True, *[None] * 7)

    def silence(self, until: int) -> list[tuple]:
        return []

    def wakes(self) -> int | None:
        return None

    def held(self) -> tuple:
        s = self.score
        return (*s.points, *s.sets, s.number, s.winner, s.last)


class SegmentMachine:
    """The open segment of one clip, fed in order; closed by a silence that lasts, seen by a sample or a timer."""

    state = "active boolean, start double, warm double, warm_at long"

    def __init__(self, rules: Rules, held: tuple | None):
        self.rules = rules
        self.active, self.start, self.warm, self.warm_at = held or (False, 0.0, 0.0, 0)

    def _gap(self) -> int:
        return round(self.rules.max_gap * 1_000_000)

    def _closed(self) -> list[tuple]:
        self.active = False
        return [(None, None, False, self.start, self.warm)] if self.warm - self.start > self.rules.min_dur else []

    def take(self, at: int, seq: int, t: float, x: float | None) -> list[tuple]:
        out = self.silence(at)
        if x is not None and self.active and x > self.rules.low:
            self.warm, self.warm_at = t, at
        elif x is not None and not self.active and x > self.rules.high:
            self.active, self.start, self.warm, self.warm_at = True, t, t, at
        return out

    def late(self, at: int, seq: int, t: float, x: float | None) -> tuple:
        return seq, t, True, None, None

    def silence(self, until: int) -> list[tuple]:
        return self._closed() if self.active and until - self.warm_at > self._gap() else []

    def wakes(self) -> int | None:
        return self.warm_at + self._gap() + 1 if self.active else None

    def held(self) -> tuple:
        return self.active, self.start, self.warm, self.warm_at


class InOrder(StatefulProcessor):
    """Feeds the machine of each key of a group with the key's rows in order of time, then of their number. Rows are the key, at (microseconds), seq and the machine's values."""

    def __init__(self, machine, options, names: list[str], columns: list[str]):
        self.machine, self.options, self.names, self.columns = machine, options, names, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "machines binary")
        self.timer = handle.getValueState("timer", "at long")

    def _frames(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(rows), FRAME_ROWS):
            yield pd.DataFrame(rows[lo : lo + FRAME_ROWS], columns=self.columns, dtype=object)

    def _wake(self, at: int, before: int | None) -> None:
        """See to it that the group's one timer is not later than ``at``."""
        # A watermark of 0 means that there is none yet.
        at = max(1, -(-at // 1000))
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        machine, first = self.machine(self.options, None), None
        for frame in rows:
            listed = list(frame[self.names].astype(object).where(frame[self.names].notna(), None).itertuples(index=False, name=None))
            early = [r for r in listed if r[1] > passed or not passed]
            if early:
                self.waiting.appendValue((pickle.dumps(early),))
                first = min(r[1] for r in early) if first is None else min(first, *(r[1] for r in early))
            if len(early) < len(listed):
                yield from self._frames([(r[0], *machine.late(*r[1:])) for r in listed if r[1] <= passed and passed])
        if first is not None:
            self._wake(first, self.timer.get()[0] if self.timer.exists() else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for (part,) in self.waiting.get() for r in pickle.loads(part)]
        # Rows of one time and number in an order of their own, so that reruns agree.
        due = sorted((r for r in rows if r[1] <= passed), key=lambda r: (r[1], r[2], [(v is not None, v) for v in r[3:]]))
        rest = [r for r in rows if r[1] > passed]
        held = pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}
        machines = {k: self.machine(self.options, h) for k, h in held.items()}
        out = []
        for k, *values in due:
            if (m := machines.get(k)) is None:
                m = machines[k] = self.machine(self.options, None)
            out += [(k, *x) for x in m.take(*values)]
        for k, m in machines.items():
            out += [(k, *x) for x in m.silence(passed)]
        self.kept.update((pickle.dumps({k: m.held() for k, m in machines.items()}),))
        if due:
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        # What is to come next: the earliest row that waits, or the end of a silence.
        self.timer.clear()
        nexts = [r[1] for r in rest] + [w for m in machines.values() if (w := m.wakes()) is not None]
        if nexts:
            self._wake(min(nexts), None)
        yield from self._frames(out)

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, machine, options, values: str, delay: str, out: str, groups: int) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in out.split(",")]
    names = [key, "at", "seq", *[v.strip().split(" ")[0] for v in values.split(",")]]
    # The column with the watermark goes: rows behind it would be dropped unseen.
    marked = rows.withColumn("marked", F.timestamp_micros("at")).withWatermark("marked", delay)
    marked = marked.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("group"), *names)
    return marked.groupBy("group").transformWithStateInPandas(InOrder(machine, options, names, columns), out, "Append", "EventTime")


ORDERED = "match_id long, seq long, ts double, late boolean, set_number int, score_a int, score_b int, sets_a int, sets_b int, is_finished boolean, winner string"
SEGMENTS = "clip long, seq long, t double, late boolean, t_start double, t_end double"


def ordered_timeline(events: DataFrame, best_of: int = 5, delay: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """A snapshot after each event of a stream of match_id, seq, ts and winner that may come up to ``delay`` late, in order of ts, then seq.

    Events that the watermark has passed are rows with ``late`` and without a score. An event goes out once the watermark is past
    it; a stream that ends keeps its last ones, unless an end mark follows (see ``sources.stream.files_in_turn``). The time must not be null.
    """
    needed_sets(best_of)
    return _in_order(events.withColumn("at", micros(F.col("ts"))), "match_id", ScoreMachine, best_of, "ts double, winner string", delay, ORDERED, groups)


def ordered_segments(samples: DataFrame, rules: Rules, delay: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """t_start and t_end of the segments of a stream of clip, seq, t and x that may come up to ``delay`` late.

    A segment ends with its last warm sample as soon as the watermark is ``max_gap`` past it, whether or not a sample
    follows; so unlike ``live_segments``, clips that end in silence have their last segment, and two warm samples farther
    apart than the gap are never in one. Late samples are rows with ``late`` and their seq and t. A null x is silence.
    """
    return _in_order(samples.withColumn("at", micros(F.col("t"))), "clip", SegmentMachine, rules, "t double, x double", delay, SEGMENTS, groups)
