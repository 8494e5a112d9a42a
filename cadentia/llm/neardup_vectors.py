"""Near-duplicate vectors: all pairs of cosine at or above a threshold, by cover trees traversed in pairs.

Equal vectors are one point with a count. Vectors go to cells around centres that lie far apart in a sample,
and cells are cut into blocks of bounded size. In each block a cover tree is built: nested levels of centres,
each level with half the radius of the one above, and for each node the true distance of its farthest point.
Two trees are traversed together from the top: a pair of nodes is dropped when the centres are farther
apart than the threshold and both radii, taken whole when even the farthest points must be near enough, and
else replaced by the pairs of their children; single points at the end are compared exactly. The same
bounds first drop pairs of cells. Each pair of blocks is compared once or, for a block with itself, in both
directions. A task takes a pair of groups of blocks, so a block moves once for each group that it meets, not for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import written
from cadentia.llm.components import Union, connected_components
from cadentia.llm.vectors import unpacked, usable

THRESHOLD = 0.9
#: Vectors in a block (about), cells at most, rows that the centres are chosen from at most.
BLOCK, CELLS, SAMPLE = 2048, 512, 2000
#: Groups that blocks are dealt to, as long as a group's matrices stay within so many bytes: a task holds one group.
GROUPS, HELD_BYTES = 12, 64 << 20
#: Tasks at most that pairs of blocks are dealt to; a task takes several blocks one after the other.
MOST_TASKS = 20_000
#: Largest radius of a tree's levels; each further level has half of it.
RADII = (0.5, 0.25, 0.125)
_SLACK = 1e-7
#: Pairs of nodes or points that are looked at together (about), and pairs of points that are worth taking whole.
PAIRS_AT_ONCE, WHOLE = 1 << 15, 64


def centres_far_apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Points of the sample, each in turn the farthest from those before: the first ones form the coarser nets."""
    if not len(sample):
        return sample
    chosen, nearest = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < most and nearest.max() > 1e-9:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the number of its centre: a greedy net, so centres are more than the radius apart."""
    near = 1 - radius * radius / 2
    centre = np.full(len(points), -1)
    for lo in range(0, len(points), 1024):
        dots = points[lo : lo + 1024] @ points.T
        for i, row in enumerate(dots, lo):
            if centre[i] < 0:
                own = (row >= near) & (centre < 0)
                own[i] = True
                centre[own] = i
    return centre


def nested_nets(points: np.ndarray) -> np.ndarray:
    """For each level, from the finest, the point that is the centre of each centre of the level below; -1 elsewhere."""
    out = np.full((len(RADII), len(points)), -1, np.int32)
    at = np.arange(len(points))
    for level, radius in enumerate(reversed(RADII)):
        out[level, at] = at[_net(points[at], radius)]
        at = np.unique(out[level, at])
    return out


class CoverTree:
    """Nested levels over unit vectors, from the coarsest; the last level is the points themselves."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, weight: np.ndarray, nets: np.ndarray):
        """nets: from ``nested_nets``."""
        self.ids, self.points, self.weight = ids, points, weight
        # From fine to coarse: the centres of a level are chosen among those of the level below.
        at = np.arange(len(points))
        levels = [(at, np.zeros(len(points)), None)]
        self.under = [[np.array([i]) for i in range(len(points))]]
        for net in nets:
            centre = net[at]
            tops = np.unique(centre)
            order = np.argsort(centre, kind="stable")
            children = np.split(order, np.searchsorted(centre[order], tops)[1:])
            below = self.under[0]
            self.under.insert(0, [np.concatenate([below[c] for c in group]) if len(group) > 1 else below[group[0]] for group in children])
            at = tops
            reach = np.array([np.linalg.norm(points[m] - points[c], axis=1).max() if len(m) > 1 else 0.0 for m, c in zip(self.under[0], at, strict=True)])
            levels.insert(0, (at, reach, _Children(children)))
        self.levels = levels
        self.sizes = [np.array([len(u) for u in level]) for level in self.under]


class _Children:
    """The children of the nodes of a level, one list after the other."""

    def __init__(self, lists: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in lists])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(lists)


def _expanded(a: np.ndarray, b: np.ndarray, ours: _Children, theirs: _Children) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of children of pairs of nodes, ``PAIRS_AT_ONCE`` at a time."""
    ends = np.cumsum(ours.sizes[a] * theirs.sizes[b])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        number = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(ends[-1])))
        pair = np.searchsorted(ends, number, side="right")
        i, j = a[pair], b[pair]
        inside = number - (ends[pair] - ours.sizes[i] * theirs.sizes[j])
        yield ours.flat[ours.begins[i] + inside // theirs.sizes[j]], theirs.flat[theirs.begins[j] + inside % theirs.sizes[j]]


class Links:
    """Numbers of links and components gathered while trees are compared."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.union = Union()

    def _add(self, ids: np.ndarray, numbers: np.ndarray) -> None:
        some = np.flatnonzero(numbers)
        for i, n in zip(ids[some].tolist(), numbers[some].tolist(), strict=True):
            self.counts[i] = self.counts.get(i, 0) + n

    def compare(self, x: CoverTree, y: CoverTree, threshold: float, one_sided: bool) -> None:
        """Traverse two trees; one_sided: they are one tree, and links are counted for the left side of ordered pairs."""
        far = np.sqrt(max(0.0, 2 - 2 * threshold))
        found = _Compared(x, y, self.union, one_sided)

        def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
            (xa, x_reach, x_children), (yb, y_reach, y_children) = x.levels[level], y.levels[level]
            if level == len(x.levels) - 1:
                good = np.einsum("ij,ij->i", x.points[a], y.points[b]) >= threshold
                if one_sided:
                    good &= a != b
                found.pairs(a[good], b[good])
                return
            gap = np.linalg.norm(x.points[xa[a]] - y.points[yb[b]], axis=1)
            reach = x_reach[a] + y_reach[b]
            near = gap <= far + reach + _SLACK
            # Cosines that close to the threshold are compared one by one, as are the points of small nodes.
            sure = near & (gap + reach <= far - 1e-6) & (x.sizes[level][a] * y.sizes[level][b] >= WHOLE)
            for i, j in zip(a[sure].tolist(), b[sure].tolist(), strict=True):
                found.whole(x.under[level][i], y.under[level][j])
            go = near & ~sure
            for left, right in _expanded(a[go], b[go], x_children, y_children):
                descend(level + 1, left, right)

        for a, b in self._near_tops(x, y, far):
            descend(0, a, b)
        self._add(x.ids, found.x_links.astype(np.int64))
        if not one_sided:
            self._add(y.ids, found.y_links.astype(np.int64))

    def _near_tops(self, x: CoverTree, y: CoverTree, far: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of top nodes that may hold links. Nodes of one point and others are bounded apart, so that the bounds are tight."""
        (xa, x_reach, _), (yb, y_reach, _) = x.levels[0], y.levels[0]
        for x_part in (np.flatnonzero(x_reach == 0), np.flatnonzero(x_reach > 0)):
            for y_part in (np.flatnonzero(y_reach == 0), np.flatnonzero(y_reach > 0)):
                if len(x_part) and len(y_part):
                    reach = far + x_reach[x_part].max() + y_reach[y_part].max() + _SLACK
                    step = max(1, PAIRS_AT_ONCE // len(y_part))
                    for lo in range(0, len(x_part), step):
                        i, j = np.nonzero(x.points[xa[x_part[lo : lo + step]]] @ y.points[yb[y_part]].T >= 1 - reach * reach / 2)
                        if len(i):
                            yield x_part[lo : lo + step][i], y_part[j]

    def result(self) -> pa.RecordBatch:
        """vec_id, its number of links found here, and the smallest vector of its component here."""
        ids = list(self.counts)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([self.counts[i] for i in ids], pa.int64()), pa.array([self.union.root(i) for i in ids], pa.int64())], names=["point", "links", "root"])


class _Compared:
    """What the comparison of two trees finds: links of each point by weight, and joined components."""

    def __init__(self, x: CoverTree, y: CoverTree, union: Union, one_sided: bool):
        self.x, self.y, self.union, self.one_sided = x, y, union, one_sided
        self.x_links, self.y_links = np.zeros(len(x.ids)), np.zeros(len(y.ids))
        #: The component of each point, as far as is known.
        self.x_in, self.y_in = x.ids.copy(), y.ids.copy()

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Points that are linked."""
        self.x_links += np.bincount(a, self.y.weight[b], minlength=len(self.x.ids))
        if not self.one_sided:
            self.y_links += np.bincount(b, self.x.weight[a], minlength=len(self.y.ids))
        self._join(a, b)

    def whole(self, left: np.ndarray, right: np.ndarray) -> None:
        """All points of one node are linked with all others of another."""
        self.x_links[left] += self.y.weight[right].sum() - (self.x.weight[left] if self.one_sided and left[0] == right[0] else 0)
        if not self.one_sided:
            self.y_links[right] += self.x.weight[left].sum()
        self._join(left, np.full(len(left), right[0]))
        self._join(np.full(len(right), left[0]), right)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        one, other = self.x_in[a], self.y_in[b]
        apart = one != other
        if not apart.any():
            return
        # Few different components meet, however many points are linked.
        met = np.unique(np.stack((one[apart], other[apart])), axis=1)
        for i, j in zip(*met.tolist(), strict=True):
            self.union.join(i, j)
        for known in (self.x_in, self.y_in):
            names, at = np.unique(known, return_inverse=True)
            known[:] = np.array([self.union.root(i) for i in names.tolist()])[at]


def _units(rows: DataFrame) -> DataFrame:
    """vec_id and vector divided by its length in double precision; null for null, empty and zero vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("vector").to_pylist():
                x = np.array(v or [], float)
                largest = np.abs(x).max(initial=0.0)
                # Scaled by the largest component first, which keeps the squares finite.
                x = x / largest if largest else x
                out.append(x / np.sqrt((x * x).sum()) if largest else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return rows.mapInArrow(run, "vec_id long, vector array<double>")


def near_duplicate_vectors(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    n_links counts the other rows whose cosine with this one, in double precision, is at least ``threshold``;
    component_id is the smallest id reachable by such links, itself included; kept says whether that is the
    own one. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor
    do rows with a null id, whose component is null. Shorter vectors count as filled up with zeros. Rows that
    repeat an id or a vector are rows like others, and equal vectors are linked. An empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull() & usable(F.col("embedding")), F.col("embedding")).alias("vector"))
    rows = written(spark, _units(rows), "cover-rows")
    points = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").cast("double").alias("weight"))
    points = written(spark, points, "cover-points")
    n, dim = points.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    few = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    sample = np.zeros((len(few), dim))
    for i, r in enumerate(few):
        sample[i, : len(r[0])] = r[0]
    centres = centres_far_apart(sample, max(1, min(CELLS, n // BLOCK)))
    found = _links(spark, points, centres, n, dim, threshold)
    found = written(spark, found, "cover-links")
    components = connected_components(spark, found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    known = points.select("vector", F.col("vec_id").alias("point"), "weight").join(counts, "point", "left").join(components.withColumnRenamed("node", "point"), "point", "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    joined = rows.join(known, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def near_blocks(blocks_of: DataFrame, near: DataFrame, blocks: int) -> DataFrame:
    """a, b and step: pairs of blocks (b, cell) whose cells are near each other (a_cell, b_cell; at most the square of ``CELLS``), each once, a block with itself included.

    Of the two orders of a pair the one counts in which b is within the half of all blocks that follow a in a circle, ``step`` places on.
    """
    half = blocks // 2
    pairs = blocks_of.select(F.col("b").alias("a"), F.col("cell").alias("a_cell")).join(F.broadcast(near), "a_cell").join(blocks_of.withColumnRenamed("cell", "b_cell"), "b_cell")
    pairs = pairs.withColumn("step", F.pmod(F.col("b") - F.col("a"), F.lit(blocks)))
    return pairs.where((F.col("step") <= half) & ((F.col("step") < blocks - half) | (F.col("a") < half))).select("a", "b", "step")


def group_size(blocks: int, dim: int) -> int:
    """Blocks in a group: a share of all, as far as their matrices may be held by one task."""
    return max(1, min(-(-blocks // GROUPS), HELD_BYTES // (BLOCK * max(dim, 1) * 8)))


def grouped_tiles(tiles: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """left, right, own and others of the blocks that a pair of groups holds (``others`` is null) and of those shown to it, with the blocks that each is compared with.

    tiles: from ``near_blocks``. A block is in each of the two once for each group that has a block near it.
    """
    lower, upper = F.least("a", "b"), F.greatest("a", "b")
    tiles = tiles.select((lower / size).cast("int").alias("left"), (upper / size).cast("int").alias("right"), lower.alias("lower"), upper.alias("upper"))
    held = tiles.select("left", "right", F.col("lower").alias("own"), F.lit(None).cast("array<int>").alias("others")).distinct()
    return held, tiles.groupBy("left", "right", F.col("upper").alias("own")).agg(F.sort_array(F.collect_list("lower")).alias("others"))


def _links(spark: SparkSession, points: DataFrame, centres: np.ndarray, n: int, dim: int, threshold: float) -> DataFrame:
    """point, links and root of what each task finds."""
    centre_of = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, dim))
            for i, v in enumerate(batch.column("vector").to_pylist()):
                x[i, : len(v)] = v
            dots = x @ centre_of.value.T if len(centre_of.value) else np.ones((len(x), 1))
            cell = dots.argmax(1)
            away = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(x)), cell]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), batch.column("weight"), pa.array(cell, pa.int32()), pa.array(away, pa.float64())], names=["vec_id", "vector", "weight", "cell", "away"])

    placed = written(spark, points.select("vec_id", "vector", "weight").mapInArrow(place, "vec_id long, vector array<double>, weight double, cell int, away double"), "cover-cells")
    cells = {r["cell"]: (r["n"], r["away"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    # Blocks are numbered through, cell by cell; a large cell has several.
    first, blocks = {}, 0
    for cell in sorted(cells):
        first[cell] = blocks
        blocks += -(-cells[cell][0] // BLOCK)
    if not blocks:
        return spark.createDataFrame([], "point long, links long, root long")
    table = F.create_map(*[F.lit(v) for c in cells for v in (c, first[c])])
    parts = F.create_map(*[F.lit(v) for c in cells for v in (c, -(-cells[c][0] // BLOCK))])
    block = (F.element_at(table, F.col("cell")) + F.pmod(F.xxhash64("vec_id"), F.element_at(parts, F.col("cell")))).cast("int")
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    names = np.array(sorted(cells))
    radius = np.array([cells[c][1] for c in names])
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centres[names] @ centres[names].T)) if len(centres) else np.zeros((len(names), len(names)))
    near = names[np.argwhere(apart - radius[:, None] - radius <= far + 1e-6)].tolist()
    packs = written(spark, _packed_blocks(placed.withColumn("own", block), dim), "cover-blocks")
    blocks_of = packs.select(F.col("own").alias("b"), "cell")
    tiles = near_blocks(blocks_of, spark.createDataFrame(near, "a_cell int, b_cell int"), blocks)
    size = group_size(blocks, dim)
    columns = ["own", "n", "dim", "ids", "matrix", "weight", "nets"]
    held, shown = (t.join(packs.select(*columns), "own") for t in grouped_tiles(tiles, size))
    groups = -(-blocks // size)
    work = held.select("left", "right", "others", *columns).unionByName(shown.select("left", "right", "others", *columns))
    work = work.repartition(min(max(groups * (groups + 1) // 2, 12), MOST_TASKS), "left", "right").sortWithinPartitions("left", "right", F.col("others").isNotNull(), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trees, links = None, {}, Links()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, matrix = unpacked(row, dim)
                tree = CoverTree(ids, matrix, np.frombuffer(row["weight"], "<f8"), np.frombuffer(row["nets"], "<i4").reshape(len(RADII), -1))
                if (row["left"], row["right"]) != key:
                    if links.counts:
                        yield links.result()
                    key, trees, links = (row["left"], row["right"]), {}, Links()
                if row["others"] is None:
                    trees[row["own"]] = tree
                else:
                    for other in row["others"]:
                        links.compare(trees[other], tree, threshold, row["own"] == other)
        if links.counts:
            yield links.result()

    return work.mapInArrow(run, "point long, links long, root long")


def _packed_blocks(placed: DataFrame, dim: int) -> DataFrame:
    """One row a block: own, cell, n, dim, ids, matrix, weight and nets."""
    rows = placed.select("own", "cell", "vec_id", "vector", "weight").repartition("own").sortWithinPartitions("own", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["own"] != key and held:
                    yield pack(held)
                    held = []
                key = row["own"]
                held.append(row)
        if held:
            yield pack(held)

    def pack(held: list[dict]) -> pa.RecordBatch:
        matrix = np.zeros((len(held), dim))
        for i, row in enumerate(held):
            matrix[i, : len(row["vector"])] = row["vector"]
        ids, weight = np.array([r["vec_id"] for r in held], "<i8"), np.array([r["weight"] for r in held], "<f8")
        values = [held[0]["own"], held[0]["cell"], len(held), dim, ids.tobytes(), matrix.tobytes(), weight.tobytes(), nested_nets(matrix).tobytes()]
        types = [pa.int32()] * 4 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["own", "cell", "n", "dim", "ids", "matrix", "weight", "nets"])

    return rows.mapInArrow(run, "own int, cell int, n int, dim int, ids binary, matrix binary, weight binary, nets binary")


ORACLE = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (
  select vec_id, list_transform(e, lambda x: x / sqrt(s)) as e from (select vec_id, e, list_sum(list_transform(e, lambda x: x * x)) as s from v) where s > 0),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
  where list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) >= 0.9),
r as (
  select vec_id as a, vec_id as c from embeddings
  union
  select l.b, r.c from r join l on r.a = l.a),
m as (select a, min(c) as component_id from r group by a),
n as (select a, count(*)::bigint as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on n.a = vec_id join m on m.a = vec_id
"""
