"""Live operators: score and segments of events as they arrive, with one small state for each key.

Rows of a micro-batch are put in order of time, in sorted runs on the task's disk beyond ``RUN_ROWS`` of a key; a row older than its key's last one is late and dropped, and
counted in the state. Segments close when a later sample shows that the silence was too long, as in the
batch form without flush.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadentia.operators.score import Score, needed_sets
from cadentia.operators.segments import Rules
from cadentia.operators.signal import fused

SNAPSHOT = "match_id long, seq long, ts double, set_number int, score_a int, score_b int, sets_a int, sets_b int, is_finished boolean, winner string"
_SCORE_STATE = "p_a int, p_b int, s_a int, s_b int, number int, winner string, last double, late long"

#: Rows of a key that are sorted at once, and rows of each frame read from a run or given out.
RUN_ROWS, FRAME_ROWS = 500_000, 10_000


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    """The rows of all frames, ordered by the columns ``by``, rows alike there as they came; never more than a run is held."""
    runs, held, size = [], [], 0
    with tempfile.TemporaryDirectory() as folder:

        def spill() -> None:
            table = pa.Table.from_pandas(pd.concat(held).sort_values(by, kind="stable"), preserve_index=False)
            runs.append(f"{folder}/{len(runs)}")
            with pa.OSFile(runs[-1], "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
                out.write_table(table, max_chunksize=FRAME_ROWS)

        def read(path: str) -> Iterator[tuple]:
            with pa.OSFile(path, "rb") as f, pa.ipc.open_stream(f) as batches:
                for batch in batches:
                    yield from batch.to_pandas().itertuples(index=False)

        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= RUN_ROWS:
                spill()
                held, size = [], 0
        if runs and held:
            spill()
        if runs:
            held = []
            yield from heapq.merge(*map(read, runs), key=lambda r: tuple(getattr(r, c) for c in by))
        elif held:
            yield from pd.concat(held).sort_values(by, kind="stable").itertuples(index=False)


def live_timeline(events: DataFrame, best_of: int = 5) -> DataFrame:
    """A snapshot after each event of a stream of match_id, seq, ts and winner."""
    needed_sets(best_of)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p_a, p_b, s_a, s_b, number, winner, last, late = state.get if state.exists else (0, 0, 0, 0, 1, None, None, 0)
        score = Score(best_of, (p_a, p_b), (s_a, s_b), number, winner, last)
        columns = [c.split(" ")[0] for c in SNAPSHOT.split(", ")]
        out = []
        for seq, ts, w in _in_order((f[["seq", "ts", "winner"]] for f in frames), ["ts", "seq"]):
            if score.last is not None and ts < score.last:
                late += 1
                continue
            score.add(float(ts), w)
            out.append((key[0], seq, ts, score.number, *score.points, *score.sets, score.winner is not None, score.winner))
            if len(out) == FRAME_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        state.update((*score.points, *score.sets, score.number, score.winner, score.last, late))
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("match_id").applyInPandasWithState(step, SNAPSHOT, _SCORE_STATE, "append", GroupStateTimeout.NoTimeout)


def live_machines(samples: DataFrame, machines: dict[str, Rules]) -> DataFrame:
    """clip, machine, t_start and t_end of closed segments of a stream of clip, t and a signal for each machine.

    Each signal, a column named like its machine, runs through thresholds of its own; all of them share one
    pass and one state of a clip. A null counts as silence.
    """
    names = list(machines)
    columns = ["clip", "machine", "t_start", "t_end"]
    fields = "".join(f"active_{i} boolean, start_{i} double, warm_{i} double, " for i in range(len(names)))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *flat, last, late = state.get if state.exists else (*(False, 0.0, 0.0) * len(names), None, 0)
        held = [list(flat[3 * i : 3 * i + 3]) for i in range(len(names))]
        out = []
        for t, *values in _in_order((f[["t", *names]].astype(float) for f in frames), ["t"]):
            if last is not None and t < last:
                late += 1
                continue
            last = t
            for name, x, one in zip(names, values, held, strict=True):
                active, start, warm = one
                if active:
                    one[2] = warm = t if x > machines[name].low else warm
                    if t - warm > machines[name].max_gap:
                        one[0] = False
                        if warm - start > machines[name].min_dur:
                            out.append((key[0], name, start, warm))
                elif x > machines[name].high:
                    one[:] = True, t, t
            if len(out) >= FRAME_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        state.update((*(v for one in held for v in one), last, late))
        yield pd.DataFrame(out, columns=columns)

    return samples.groupBy("clip").applyInPandasWithState(step, "clip long, machine string, t_start double, t_end double", fields + "last double, late long", "append", GroupStateTimeout.NoTimeout)


def live_segments(samples: DataFrame, rules: Rules) -> DataFrame:
    """clip, t_start and t_end of closed segments of a stream of clip, t and x."""
    return live_machines(samples, {"x": rules}).select("clip", "t_start", "t_end")


def table_and_fused(samples: DataFrame, table_rules: Rules, fused_rules: Rules, pairs: list[tuple[str, str]]) -> DataFrame:
    """Segments of a stream of clip, t and table: once of the table's signal alone (machine ``table``), once
    fused with the signals of ``pairs`` (signal, gate) where their gate is open (machine ``fused``)."""
    both = fused(samples, "table", pairs, "fused")
    return live_machines(both.select("clip", "t", "table", "fused"), {"table": table_rules, "fused": fused_rules})
