"""Exact top-k by inner product, over vectors in the order of descending length.

Components are turned into integers. Vectors are cut into blocks by descending length. Every query first
meets the longest vectors; the k-th best score among them is its bar, and a block of candidates only moves to
those blocks of queries for which length times length may reach a bar. Blocks are dealt to stripes, and a task
takes one block of queries, which starts with those bars, through one stripe. With the k-th best score so far
as the bar, a chunk is skipped once length times length stays below it; otherwise the partial sum over the
leading axes of a rotation (from the singular vectors of a sample) plus the Cauchy-Schwarz bound of the rest
decides which pairs are worth the exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.llm.common import written
from cadentia.llm.vectors import packed, unpacked, usable

SCALE, K, QUERY_STEP = 64.0, 20, 20
#: Vectors in a block, queries in a block, blocks in a stripe at most, vectors in a chunk.
BLOCK, QUERIES, STRIPE, CHUNK = 2048, 4096, 64, 512
#: Rows that the rotation is fitted on at most, and the share of their squared length that leading axes hold.
SAMPLE, LEADING = 2000, 0.6
#: Tasks at most that blocks of queries and stripes are dealt to; a task takes several of these one after the other.
MOST_TASKS = 20_000
_EXACT, _LONG = 2.0**53, 2**63 - 1


def _floor(x: Column) -> Column:
    """Floor as a double, so that large values don't overflow."""
    nearest = F.rint(x)
    return F.when(nearest > x, nearest - 1.0).otherwise(nearest)


def _lengths(m: np.ndarray) -> np.ndarray:
    """Lengths of the rows, scaled by the largest component so that squares stay finite."""
    largest = float(np.abs(m).max(initial=0.0))
    return largest * np.sqrt(((m / largest) ** 2).sum(1)) if largest else np.zeros(len(m))


class Rotation:
    """Right singular vectors of a sample as new axes, and how many of them lead."""

    def __init__(self, sample: np.ndarray):
        dim = sample.shape[1]
        if len(sample) and dim:
            scaled = sample / max(1.0, float(np.abs(sample).max()))
            _, s, axes = np.linalg.svd(scaled, full_matrices=True)
            energy = np.zeros(dim)
            energy[: len(s)] = s * s
            self.axes = axes.T
            self.lead = int(np.searchsorted(np.cumsum(energy), LEADING * energy.sum()) + 1)
        else:
            self.axes, self.lead = np.eye(dim), dim
        self.lead = min(self.lead, dim)


class Search:
    """Best candidates of a block of queries, taken over chunks of candidates of descending length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: Rotation, k: int, bar: np.ndarray | None = None):
        self.ids, self.q, self.k, self.rotation = ids, vectors, k, rotation
        self.length = _lengths(vectors)
        turned = vectors @ rotation.axes
        self.head, tail = turned[:, : rotation.lead], turned[:, rotation.lead :]
        self.tail = _lengths(tail)
        #: Scores that k candidates of each query are known to reach.
        self.bar = np.full(len(ids), -np.inf) if bar is None else bar.copy()
        #: Kept pairs: query, score, candidate id.
        self.kept: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0

    def needed(self) -> float:
        """A length that candidates must have to matter to any of the queries, a little less for rounding."""
        if not len(self.ids) or np.isinf(self.bar).any():
            return -np.inf
        least = self.bar - 1e-8 * (1 + np.abs(self.bar))
        least = np.where(self.length > 0, least / np.where(self.length > 0, self.length, 1), -np.inf).min()
        return float(least) if least == least else -np.inf

    def take(self, ids: np.ndarray, x: np.ndarray) -> bool:
        """Look at candidates sorted by descending length; False once no later one can matter."""
        for lo in range(0, len(ids), CHUNK):
            if not self._chunk(ids[lo : lo + CHUNK], x[lo : lo + CHUNK]):
                return False
        return True

    def _chunk(self, ids: np.ndarray, x: np.ndarray) -> bool:
        length = _lengths(x)
        slack = 1e-9 * (1 + self.length * length.max())
        active = np.flatnonzero(~(self.length * length.max() + slack < self.bar))
        if not len(active):
            return False
        turned = x @ self.rotation.axes
        tail = _lengths(turned[:, self.rotation.lead :])
        exact = self.largest * (float(np.abs(x).max()) if x.size else 0.0) * x.shape[1] < _EXACT
        for part in np.array_split(active, max(1, len(active) // 1024)):
            bar = self.bar[part][:, None]
            if np.isinf(bar).any():
                qi, ci = np.divmod(np.arange(len(part) * len(ids)), len(ids))
            else:
                bound = self.head[part] @ turned[:, : self.rotation.lead].T + self.tail[part][:, None] * tail + slack[part][:, None]
                qi, ci = np.nonzero(~(bound < bar))
            if not len(qi):
                continue
            if not exact:
                scores = np.array([float(max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(self.q[part[i]], x[j], strict=True))))) for i, j in zip(qi, ci, strict=True)])
            elif len(qi) * 8 > len(part) * len(ids):
                scores = (self.q[part] @ x.T)[qi, ci]
            else:
                scores = np.einsum("ij,ij->i", self.q[part[qi]], x[ci])
            good = (scores >= self.bar[part[qi]]) & (self.ids[part[qi]] != ids[ci])
            self._keep(part[qi[good]], scores[good], ids[ci[good]])
        return True

    def _keep(self, query: np.ndarray, score: np.ndarray, candidate: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        before = np.isin(self.kept[0], touched)
        q, s, c = (np.concatenate((old[before], new)) for old, new in zip(self.kept, (query, score, candidate), strict=True))
        order = np.lexsort((c, -s, q))
        q, s, c = q[order], s[order], c[order]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = place == self.k - 1
        self.bar[q[last]] = s[last]
        keep = place < self.k
        self.kept = tuple(np.concatenate((old[~before], new[keep])) for old, new in zip(self.kept, (q, s, c), strict=True))

    def found(self) -> pa.RecordBatch:
        q, s, c = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array([int(min(max(v, -(2.0**63)), 2.0**63 - 1024)) for v in s.tolist()], pa.int64())], names=["query_id", "vec_id", "score"])


def reached_pairs(candidates: DataFrame, queries: DataFrame, stripes: int) -> DataFrame:
    """block, q and stripe: which blocks of candidates (block, length) meet which blocks of queries (block, needed): those that their longest vector is long enough for.

    Blocks of queries are numbered by what they need, so what a block of candidates reaches is a beginning of them, whose end one
    sort of both kinds' lengths, one row a block, tells. There are as many rows as pairs that meet.
    """
    ranked = queries.select(F.col("block").alias("q"), "needed", F.row_number().over(Window.orderBy("needed", "block")).alias("place"))
    asked = ranked.select(F.col("needed").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("block"))
    long = candidates.select((F.col("length") * (1 + 1e-8) + 1e-8).alias("at"), F.lit(1).alias("side"), "block")
    so_far = Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(long).withColumn("reach", F.sum(1 - F.col("side")).over(so_far)).where("side = 1 and reach > 0")
    met = met.select("block", F.explode(F.sequence(F.lit(1), F.col("reach").cast("int"))).alias("place")).join(ranked, "place")
    return met.select("block", "q", F.pmod("block", F.lit(stripes)).cast("int").alias("stripe"))


def top_inner_products(spark: SparkSession, embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` other vectors of largest inner product for every query.

    Queries are the vectors whose id is divisible by ``query_step``; every component x counts as
    floor(scale * x). Ties go to the smaller id; with fewer than k others all are given. Vectors that are
    null or hold null or non-finite components, and null ids, take no part. Of rows that repeat an id the
    smallest vector counts; shorter vectors count as filled up with zeros; products beyond 64 bits are
    clipped. An empty table gives no rows; other columns are ignored.
    """
    whole = F.transform("embedding", lambda x: _floor(F.lit(scale) * x.cast("double")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = rows.withColumn("squares", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = written(spark, rows, "topk-rows")
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_step == 0), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))
    stripes = max(-(-blocks // STRIPE), min(blocks, 12))
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    sample = np.zeros((len(few), dim))
    for i, r in enumerate(few):
        sample[i, : len(r[0])] = r[0]
    rotation = spark.sparkContext.broadcast(Rotation(sample))
    by_length = rows.repartitionByRange(blocks, F.desc("squares"), F.asc("vec_id")).sortWithinPartitions(F.desc("squares"), F.asc("vec_id"))

    def with_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield row.append_column("length", pa.array([float(_lengths(unpacked(row.to_pylist()[0], dim)[1]).max())]))

    candidates = written(spark, packed(by_length, []).mapInArrow(with_length, "block int, n int, dim int, ids binary, matrix binary, length double"), "topk-blocks")
    queries = packed(rows.where(F.col("vec_id") % query_step == 0).repartition(query_blocks), [])
    longest = spark.sparkContext.broadcast([unpacked(r.asDict(), dim) for r in candidates.orderBy("block").limit(1).collect()])

    def with_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                search = Search(*unpacked(row, dim), rotation.value, k)
                for ids, matrix in longest.value:
                    search.take(ids[:BLOCK], matrix[:BLOCK])
                yield pa.RecordBatch.from_pylist([{**row, "bar": search.bar.astype("<f8").tobytes(), "needed": search.needed()}], pa.schema([*batch.schema, pa.field("bar", pa.binary()), pa.field("needed", pa.float64())]))

    queries = written(spark, queries.mapInArrow(with_bars, "block int, n int, dim int, ids binary, matrix binary, bar binary, needed double"), "topk-queries")
    columns = ["side", "block", "n", "dim", "ids", "matrix", "bar"]
    pairs = written(spark, reached_pairs(candidates, queries, stripes), "topk-pairs")
    dealt = pairs.select("q", "stripe").distinct().join(queries.withColumn("q", F.col("block")), "q").select(F.lit(0).alias("side"), *columns[1:], "q", "stripe")
    offered = candidates.join(pairs, "block").select(F.lit(1).alias("side"), *columns[1:6], F.lit(None).cast("binary").alias("bar"), "q", "stripe")
    tasks = dealt.unionByName(offered).repartition(min(query_blocks * stripes, MOST_TASKS), "q", "stripe").sortWithinPartitions("q", "stripe", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, search, over = None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if (row["q"], row["stripe"]) != key:
                    if search is not None:
                        yield search.found()
                    key, search, over = (row["q"], row["stripe"]), None, False
                ids, matrix = unpacked(row, dim)
                if row["side"] == 0:
                    search = Search(ids, matrix, rotation.value, k, np.frombuffer(row["bar"], "<f8"))
                elif search is not None and not over:
                    over = not search.take(ids, matrix)
        if search is not None:
            yield search.found()

    found = tasks.select("q", "stripe", *columns).mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
