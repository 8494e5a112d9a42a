"""Periodic runs of words: stretches that repeat a shorter stretch, whatever its length.

A text becomes one big integer for each bit of its word ids, the bit of word i at place i. Shifting a plane by a
lag and XOR-ing it with itself marks words that differ from the one a lag later; the OR over planes has zeros
where whole words agree. AND-ing the complement with itself, shifted by 1, 2, 4, ... isolates zero stretches that
are long enough for a run of that period, and each of them is one.

Which lags are looked at: a run of period q has q or more words in a row (12 - q below 6) that equal those q later, so
it holds a whole block of words, on a grid of half that length, which occurs again at that lag. Hashes of
all windows of a block's length, doubled from level to level, are compared at all lags of a level at once, for many texts
together. That finds every lag at which a run can be, and is about two comparisons a word and level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import text_slices
from cadentia.llm.words import mixed

#: A run has at least so many words, and two periods.
LEAST_WORDS = 12
#: Lags of the first level; each later one has those up to twice as long.
SHORT_LAGS, SHORT_BLOCK = LEAST_WORDS - 1, LEAST_WORDS // 4
#: Comparisons done at once, and bytes of a text that are split at once.
AT_ONCE, PIECE = 1 << 22, 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


def _words(text: str | None) -> Iterator[list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    start = 0
    while start < len(data):
        blank = _BLANK.search(data, start + PIECE)
        end = blank.start() if blank else len(data)
        yield data[start:end].split()  # at the same blanks
        start = end


def word_ids(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Ids of the words of each text, and the words by id."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = [np.concatenate([np.empty(0, np.int32), *[np.array([number(w, len(known)) for w in piece], np.int32) for piece in _words(t)]]) for t in texts]
    return ids, list(known)


def least_stretch(period: int) -> int:
    """Words in a row that must equal those a period later."""
    return max(period, LEAST_WORDS - period)


def planes(ids: np.ndarray) -> list[int]:
    dense = np.unique(ids, return_inverse=True)[1]
    return [int.from_bytes(np.packbits((dense >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(int(dense.max(initial=0)).bit_length())]


def stretches(bits: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """Start and end of all maximal stretches of at least ``least`` words that equal those ``lag`` later."""
    differ = 0
    for plane in bits:
        differ |= plane ^ (plane >> lag)
    same, held = ~differ & ((1 << (n - lag)) - 1), 1
    while same and held < least:
        step = min(held, least - held)
        same &= same >> step
        held += step
    if not same:
        return []
    # A place is left where ``least`` words in a row agree from there on.
    left = np.unpackbits(np.frombuffer(same.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little").astype(np.int8)
    edges = np.flatnonzero(np.diff(left, prepend=0, append=0)).tolist()
    return [(a, b - 1 + least) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _covered(run: Run, runs: list[Run]) -> bool:
    """Whether a run of a divisor of the period covers the run, whose period then is not the smallest."""
    start, length, period = run
    return any(period % p == 0 and s <= start and start + length <= s + n for s, n, p in runs)


def _unexplained(a: np.ndarray, lag: np.ndarray, block: int, runs: list[Run]) -> np.ndarray:
    """Lags of blocks, by place, without those that a run of a divisor of the lag covers together with their copy: these cannot belong to a run of smallest period ``lag``."""
    new = np.ones(len(a), bool)
    for start, length, period in runs:
        part = slice(*np.searchsorted(a, [start, start + length]))
        new[part] &= (lag[part] % period != 0) | (a[part] + lag[part] + block > start + length)
    return lag[new]


def _levels(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block, first and last lag of each level."""
    if longest >= LEAST_WORDS:
        yield SHORT_BLOCK, 1, min(SHORT_LAGS, longest // 2)
    low = LEAST_WORDS
    while 2 * low <= longest:
        yield low // 2, low, min(2 * low - 1, longest // 2)
        low *= 2


def _joined(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of windows and of those ``by`` places on, together. Windows that run beyond the end have any value."""
    out = mixed(h)
    out[: len(h) - by] += h[by:]
    return out


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """Start, length and period of all runs of each text, given as word ids, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.concatenate([np.empty(0, np.int32), *texts])
    ends = np.cumsum(sizes)
    found: list[list[Run]] = [[] for _ in texts]
    bits: dict[int, list[int]] = {}
    h, width = mixed(ids.astype(np.uint64) + np.uint64(0x51ED27)), 1
    for block, low, high in _levels(int(sizes.max(initial=0))):
        if width == 1:
            h = _joined(_joined(h, 1), 1)  # of three places, the middle one counts twice
        else:
            h = _joined(h, width)
        width = block
        padded = np.concatenate([h, np.zeros(high, np.uint64)])
        ahead = np.lib.stride_tricks.sliding_window_view(padded[low:], high - low + 1)
        at_once = max(1, AT_ONCE // (high - low + 1)) * block
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(h), at_once):
            row, lag = np.nonzero(ahead[start : start + at_once : block] == h[start : start + at_once : block, None])
            a, lag = start + row * block, lag + low
            inside = a + lag + block <= ends[np.searchsorted(ends, a, "right")]
            hits.append((a[inside], lag[inside]))
        a, lag = (np.concatenate(x) for x in zip(*hits, strict=True))
        owner = np.searchsorted(ends, a, "right")
        for k in np.unique(owner).tolist():
            part, n, runs = slice(*np.searchsorted(owner, [k, k + 1])), int(sizes[k]), found[k]
            for q in np.unique(_unexplained(a[part] - (ends[k] - n), lag[part], block, runs)).tolist():
                if k not in bits:
                    bits[k] = planes(texts[k])
                new = [(s, e - s + q, q) for s, e in stretches(bits[k], n, q, least_stretch(q))]
                runs += [r for r in new if not _covered(r, runs)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(ids: np.ndarray, runs: list[Run], words: list[bytes]) -> str:
    """The words, joined by blanks, without those that a run has after its first period."""
    keep = np.ones(len(ids), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in ids[keep].tolist()]).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    Words are runs of characters other than space and 0x09-0x0D, numbered from 0, and equal only if all their bytes
    are. A run is a stretch of at least ``LEAST_WORDS`` words and two periods that no neighbouring word extends,
    its period the smallest. A null, empty or blank text has no words, no runs and an empty collapsed text. Texts of any
    length are taken whole, each in one task, in memory of about fifteen bytes a byte. A row that repeats an id or text is a row like others; a null id stays null.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text", 1 << 20):
            ids, words = word_ids(texts)
            runs = runs_of(ids)
            kept = [collapsed(i, r, words) for i, r in zip(ids, runs, strict=True)]
            listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
            columns = [part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(listed, pa.list_(_RUN)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def run_digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equals the one that starts first, then of smallest period) and digests of all runs and of the collapsed text."""
    ordered = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    rows = runs.select("doc_id", "runs", "collapsed", F.array_max(ordered).alias("top"))
    start, length, period = -F.col("top.before"), F.col("top.length"), -F.col("top.shorter")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.shorter").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
