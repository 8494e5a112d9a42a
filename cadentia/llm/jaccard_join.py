"""Near-duplicate texts: Jaccard join of word shingles with adaptive multi-match prefixes.

Shingles have one global order: rare ones, by a count over all texts, before frequent ones. Let a text with n
shingles need at least t = ceil(threshold * n) of them in common with any partner. Two texts that have so many
in common share at least m of the first n - t + m of either. So each text may choose its own m: a longer
prefix costs more postings but asks for more shared ones, and fewer pairs come to be compared. The choice
weighs the postings that the counts predict against the comparisons; a pair has to share the smaller m of
the two.

Steps: (1) Texts with equal sets are one node. (2) Postings meet by shingle. Those that only one text has end
there; a short list becomes pairs at once; only long lists, which groups of copies and common passages make,
are kept, with a parity bitmap for each text that is in any. (3) In rounds, each text of a long list is given
the one partner of another component that the bitmaps show nearest; the links are checked on the texts and
joined to components. A round takes as many checks as texts, and rounds go on while they settle texts. (4) What
is still open in long lists are pairs of different components that the bitmaps let pass. They and those of the
short lists are counted over all lists; those with enough shared postings, and bitmaps near enough, are checked
on the texts. In a very long list, texts of its largest component are not compared with each other; what is left is
cut into blocks, and pairs of blocks go to different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import BROADCAST_ROWS, small_or_plain, text_slices, written
from cadentia.llm.components import connected_components
from cadentia.llm.shingles import shingle_sets

#: Buckets of the counts, as a power of two, and rows that they are kept in.
BUCKET_BITS, COUNT_ROWS = 20, 64
BUCKETS = 1 << BUCKET_BITS
#: Most shared postings asked for, and the cost of a comparison against a posting.
MOST_MATCHES, COMPARISON = 6, 4.0
#: Postings that make a list long, those of a block of a very long one, and texts checked against one other in one task.
LONG, LIST_BLOCK, CHECK_BLOCK = 8, 1024, 1000
#: Rounds go on while one settles this share of the texts in long lists, and are so many at most; what they leave is compared in step (4).
SETTLES, MOST_ROUNDS = 0.01, 8
#: Bits of a parity bitmap for each shingle, at least and at most, and at most with postings of long lists.
BITS_EACH, LEAST_BITS, MOST_BITS, LIST_BITS = 4, 512, 1 << 15, 2048
_WORDS_AT_ONCE = 1 << 21


def _percent(threshold: float) -> int:
    """The threshold in thousandths, so that comparisons are exact in integers."""
    return round(threshold * 1000)


def needed(n: int, thousandths: int) -> int:
    """Shingles that a text with n of them has in common with any partner, at least."""
    return -(-thousandths * n // 1000)


def alike(common: int, a: int, b: int, thousandths: int) -> bool:
    return 1000 * common >= thousandths * (a + b - common)


def bitmap_bits(n: int) -> int:
    return min(max(LEAST_BITS, BITS_EACH << max(n - 1, 0).bit_length()), MOST_BITS)


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """For each of ``bitmap_bits`` bits, whether an odd number of shingles fall on it.

    Two sets differ in at least as many shingles as their bitmaps differ in bits.
    """
    bits = bitmap_bits(len(shingles))
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def folded(bitmap: bytes, bits: int) -> bytes:
    """The parity bitmap of that many bits at most, from a longer one: halves are taken together."""
    words = np.frombuffer(bitmap, np.uint64)
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words.tobytes()


class Bitmaps:
    """The parity bitmaps of many sets, folded to the length that two sets have in common when they are compared."""

    def __init__(self, bitmaps: list[bytes], n: np.ndarray):
        self.n = n
        self.words = np.array([len(b) // 8 for b in bitmaps])
        self.row = np.arange(len(bitmaps))
        self.folded: dict[int, np.ndarray] = {}
        lengths = sorted(set(self.words.tolist()), reverse=True)
        longer = np.empty((0, 0), np.uint64)
        at = np.empty(0, np.int64)
        for words in lengths:
            while longer.shape[1] > words:
                half = longer.shape[1] // 2
                longer = longer[:, :half] ^ longer[:, half:]
            own = np.flatnonzero(self.words == words)
            rows = np.frombuffer(b"".join([bitmaps[i] for i in own]), np.uint64).reshape(len(own), words)
            longer = np.concatenate((longer.reshape(len(at), words), rows))
            at = np.concatenate((at, own))
            self.folded[words] = longer
        # A set keeps its place in the matrices of all shorter lengths.
        self.row[at] = np.arange(len(at))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of sets, shingles that both may have at most."""
        differ = np.empty(len(i), np.int64)
        words = np.minimum(self.words[i], self.words[j])
        for length, matrix in self.folded.items():
            at = np.flatnonzero(words == length)
            for part in np.array_split(at, max(1, len(at) * length // _WORDS_AT_ONCE)):
                differ[part] = np.bitwise_count(matrix[self.row[i[part]]] ^ matrix[self.row[j[part]]]).sum(1, dtype=np.int64)
        return np.minimum((self.n[i] + self.n[j] - differ) // 2, np.minimum(self.n[i], self.n[j]))


def prefix(shingles: np.ndarray, counts: np.ndarray, texts: float, thousandths: int) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set in the global order, and the matches that it asks for."""
    n = len(shingles)
    t = needed(n, thousandths)
    seen = counts[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((shingles, seen))
    base = n - t + 1
    most = min(MOST_MATCHES, t)
    # What a shingle's count is above that of an average bucket is put down to itself.
    partners = np.maximum(seen[order[: base + most - 1]].astype(float) - texts, 0.0)
    postings = np.cumsum(partners)[base - 1 :]
    m = int(np.argmin(postings + COMPARISON * postings / np.arange(1, most + 1) + 1e-3 * np.arange(most))) + 1
    return shingles[order[: base + m - 1]], m


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """Of each text doc_id, n, fingerprint and bitmap (kind 0); and the counts of each task (kind 1: n is the part's number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(BUCKETS, np.int64), []

        def count() -> None:
            if held:
                np.add(counts, np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS), out=counts)
                held.clear()

        def rows(kind: int, ids: pa.Array, numbers: list[int], prints: pa.Array, bits: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([kind] * len(bits), pa.int32()), ids, pa.array(numbers, pa.int64()), prints, pa.array(bits, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "doc_id", "n", "fingerprint", "bitmap"])

        for part, texts in text_slices(batches, "text"):
            sets = shingle_sets(texts, width)
            held += sets
            if sum(map(len, held)) > BUCKETS:
                count()
            yield rows(0, part.column("doc_id").cast(pa.int64()), [len(s) for s in sets], pa.array([_fingerprint(s) for s in sets], pa.binary()), [parity_bitmap(s) for s in sets])
        count()
        if counts.any():
            parts = np.split(counts.astype("<u4"), COUNT_ROWS)
            yield rows(1, pa.nulls(COUNT_ROWS, pa.int64()), list(range(COUNT_ROWS)), pa.nulls(COUNT_ROWS, pa.binary()), [p.tobytes() for p in parts])

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, fingerprint binary, bitmap binary")


def _fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _counted(summaries: DataFrame) -> np.ndarray:
    """The counts of all tasks together: as many numbers at every size of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column("n").to_pylist(), batch.column("bitmap").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(own, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()], pa.binary())], names=["n", "bitmap"])

    out = np.zeros((COUNT_ROWS, BUCKETS // COUNT_ROWS), np.uint32)
    for r in summaries.where("kind = 1").select("n", "bitmap").repartition(COUNT_ROWS, "n").mapInArrow(run, "n long, bitmap binary").collect():
        out[r["n"]] = np.frombuffer(r["bitmap"], "<u4")
    return out.ravel()


def _postings(spark: SparkSession, docs: DataFrame, counts: np.ndarray, width: int, thousandths: int) -> DataFrame:
    """shingle, doc_id, n and m of every chosen prefix."""
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        average = float(shared.value.mean())
        for part, texts in text_slices(batches, "text"):
            sets = shingle_sets(texts, width)
            found = [prefix(s, shared.value, average, thousandths) if len(s) else (s, 0) for s in sets]
            sizes = np.array([len(p) for p, _ in found])
            ids = np.repeat(part.column("doc_id").cast(pa.int64()).to_numpy(), sizes)
            shingles = np.concatenate([p for p, _ in found]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles), pa.array(ids, pa.int64()), pa.array(np.repeat([len(s) for s in sets], sizes).astype(np.int32)), pa.array(np.repeat([m for _, m in found], sizes).astype(np.int32))],
                names=["shingle", "doc_id", "n", "m"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "shingle long, doc_id long, n int, m int")


def _met(postings: DataFrame, thousandths: int) -> DataFrame:
    """Postings of shingles that several texts have: those of long lists as they are (kind 0), short lists as pairs (kind 1).

    A pair has shingle, doc_id = a and other = b, and m = the matches that it needs. In every list a stands before
    b in the order of sizes and ids; pairs whose sizes are too different are left out.
    """
    columns = ["shingle", "doc_id", "n", "m"]

    def given(kind: int, shingle: np.ndarray, doc: np.ndarray, other: pa.Array, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        out = [pa.array(np.full(len(doc), kind, np.int32)), pa.array(shingle, pa.int64()), pa.array(doc, pa.int64()), other, pa.array(n, pa.int32()), pa.array(m, pa.int32())]
        return pa.RecordBatch.from_arrays(out, names=["kind", "shingle", "doc_id", "other", "n", "m"])

    def parted(t: dict[str, np.ndarray], length: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lists, and for each posting the length of its list."""
        long = length >= LONG
        if long.any():
            yield given(0, *(t[c][long] for c in ("shingle", "doc_id")), pa.nulls(int(long.sum()), pa.int64()), t["n"][long], t["m"][long])
        short = (length > 1) & ~long
        if not short.any():
            return
        shingle, doc, n, m = (t[c][short] for c in columns)
        order = np.lexsort((doc, n, shingle))
        shingle, doc, n, m = shingle[order], doc[order], n[order].astype(np.int64), m[order]
        for back in range(1, LONG - 1):
            i, j = np.arange(len(doc) - back), np.arange(back, len(doc))
            good = (shingle[i] == shingle[j]) & (1000 * n[i] >= thousandths * n[j])
            i, j = i[good], j[good]
            if len(i):
                yield given(1, shingle[i], doc[i], pa.array(doc[j], pa.int64()), n[j], np.minimum(m[i], m[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last list so far: its postings, or only its shingle once it is known to be long.
        held, long_one = {c: np.empty(0, np.int64) for c in columns}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: np.concatenate((held[c], batch.column(c).to_numpy())) for c in columns}
            begins = np.flatnonzero(np.concatenate(([True], t["shingle"][1:] != t["shingle"][:-1])))
            sizes = np.diff(np.append(begins, len(t["shingle"])))
            lengths = sizes.copy()
            if t["shingle"][0] == long_one:
                lengths[0] = LONG
            open_ = int(sizes[-1]) if lengths[-1] < LONG else 0
            long_one = int(t["shingle"][-1]) if lengths[-1] >= LONG else None
            cut = len(t["shingle"]) - open_
            yield from parted({c: v[:cut] for c, v in t.items()}, np.repeat(lengths, sizes)[:cut])
            held = {c: v[cut:] for c, v in t.items()}
        yield from parted(held, np.full(len(held["shingle"]), len(held["shingle"])))

    ordered = postings.repartition("shingle").sortWithinPartitions("shingle")
    return ordered.mapInArrow(run, "kind int, shingle long, doc_id long, other long, n int, m int")


def _sets(summaries: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n and bitmap of some documents, once each."""
    rows = ids.count()
    return summaries.join(small_or_plain(ids, rows), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))


def _list_bitmaps(sets: DataFrame) -> DataFrame:
    """doc_id and bitmap, short enough to go with every posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([folded(b, LIST_BITS) for b in batch.column("bitmap").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bits], names=["doc_id", "bitmap"])

    return sets.select("doc_id", "bitmap").mapInArrow(run, "doc_id long, bitmap binary")


def _bounded(spark: SparkSession, pairs: DataFrame, summaries: DataFrame, thousandths: int) -> DataFrame:
    """The pairs (a, b) that bitmaps do not rule out."""
    ids = written(spark, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "join-ids")
    sets = written(spark, _sets(summaries, ids), "join-sets")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("bitmap").alias(f"{c}_bits")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                n = np.concatenate([batch.column(c).to_numpy() for c in ("a_n", "b_n")])
                maps = Bitmaps(batch.column("a_bits").to_pylist() + batch.column("b_bits").to_pylist(), n)
                i = np.arange(batch.num_rows)
                common = maps.common(i, i + batch.num_rows)
                yield batch.select(["a", "b"]).filter(pa.array(alike(common, n[i], n[i + batch.num_rows], thousandths)))

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _checked(spark: SparkSession, pairs: DataFrame, docs: DataFrame, width: int, thousandths: int) -> DataFrame:
    """The pairs (a, b) whose texts are alike. Each a meets its partners in groups; a text travels once for each of its groups."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECK_BLOCK).alias("groups"))
    groups = written(spark, groups.where("groups > 1"), "join-groups")
    salted = pairs.join(small_or_plain(groups, groups.count()), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).cast("int"))
    roles = salted.select("a", "salt", F.col("b").alias("doc_id"), F.lit(1).alias("side")).union(salted.select("a", "salt", F.col("a").alias("doc_id"), F.lit(0).alias("side")).distinct())
    roles = written(spark, roles, "join-roles")
    rows = roles.count()
    if rows == 0:
        return pairs.select("a", "b").limit(0)
    work = docs.select("doc_id", "text").join(small_or_plain(roles, rows), "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "side", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for part, texts in text_slices(batches, "text"):
            out_a, out_b = [], []
            for a, side, doc, s in zip(part.column("a").to_pylist(), part.column("side").to_pylist(), part.column("doc_id").to_pylist(), shingle_sets(texts, width), strict=True):
                if side == 0:
                    hub, hub_set = a, s
                elif a == hub:
                    common = len(np.intersect1d(hub_set, s, assume_unique=True))
                    if alike(common, len(hub_set), len(s), thousandths):
                        out_a.append(a)
                        out_b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return work.select("a", "salt", "side", "doc_id", "text").mapInArrow(run, "a long, b long")


class _Lists:
    """Whole long lists, or pairs of blocks of them, one after the other, each in order of size."""

    def __init__(self, t: pa.Table, begins: np.ndarray, thousandths: int):
        self.block, self.n, self.doc, self.m, self.component, x, y = (t[c].to_numpy() for c in ("block", "n", "doc_id", "m", "component", "x", "y"))
        self.n, self.across, self.thousandths = self.n.astype(np.int64), x != y, thousandths
        self.ends = np.append(begins, t.num_rows)
        #: Postings of one text share a bitmap.
        docs, first, self.set = np.unique(self.doc, return_index=True, return_inverse=True)
        self.maps = Bitmaps(t["bitmap"].take(pa.array(first)).to_pylist(), self.n[first])
        #: How many postings of the same list stand before each.
        self.earlier = np.arange(t.num_rows) - np.repeat(begins, np.diff(self.ends))

    def open_(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For positions i before j of one list: not of one component, not of one block if blocks meet, not ruled out by size."""
        ok = (self.component[i] != self.component[j]) & (1000 * self.n[i] >= self.thousandths * self.n[j])
        return ok & ((self.block[i] != self.block[j]) | ~self.across[i])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs that may link."""
        left, back = np.arange(len(self.n)), 0
        while True:
            back += 1
            left = left[self.earlier[left] >= back]
            # Lists are in order of size: all before are smaller still.
            left = left[1000 * self.n[left - back] >= self.thousandths * self.n[left]]
            if not len(left):
                break
            j = left[self.open_(left - back, left)]
            i = j - back
            good = alike(self.maps.common(self.set[i], self.set[j]), self.n[i], self.n[j], self.thousandths)
            yield i[good], j[good]

    def nearest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each posting the one of its list that the bitmaps show nearest, of those that may link; and how near."""
        for lo, hi in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True):
            best, near = np.full(hi - lo, -1), np.zeros(hi - lo)
            for start in range(lo, hi, 64):
                rows = np.arange(start, min(start + 64, hi))
                i, j = np.repeat(np.arange(lo, hi), len(rows)), np.tile(rows, hi - lo)
                i, j = i[i < j], j[i < j]
                may = self.open_(i, j)
                i, j = i[may], j[may]
                common = self.maps.common(self.set[i], self.set[j])
                good = alike(common, self.n[i], self.n[j], self.thousandths)
                i, j, common = i[good], j[good], common[good]
                share = common / (self.n[i] + self.n[j] - common)
                order = np.argsort(share, kind="stable")
                for own, other in ((i, j), (j, i)):
                    pair = np.full(hi - lo, -1)
                    pair[own[order] - lo] = order  # of several the last is kept, which is the nearest
                    some = np.flatnonzero(pair >= 0)
                    some = some[share[pair[some]] > near[some]]
                    best[some], near[some] = other[pair[some]], share[pair[some]]
            has = np.flatnonzero(best >= 0)
            yield has + lo, best[has], near[has]


def _long_pairs(spark: SparkSession, postings: DataFrame, components: DataFrame | None, thousandths: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of different components that meet in a long list and may link.

    With ``whole`` all of them, and needs: how many matches they ask for. Else for each text b the one a that is
    nearest to it of a block of its list, and near: how near, by the bitmaps.
    """
    rows = postings.withColumn("component", F.col("doc_id"))
    if components is not None:
        nodes = components.select(F.col("node").alias("doc_id"), "component")
        rows = postings.join(small_or_plain(nodes, nodes.count()), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # Lists of a single component are settled. In a very long one, its largest component has blocks of its own.
    parts = rows.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    lists = parts.groupBy("shingle").agg(F.sum("size").alias("length"), F.max("size").alias("most"), F.max_by("component", "size").alias("main")).where("most < length")
    mains = F.when(F.col("length") <= LIST_BLOCK, 0).otherwise(F.ceil(F.col("most") / LIST_BLOCK)).cast("int")
    others = F.when(F.col("length") <= LIST_BLOCK, 1).otherwise(F.ceil((F.col("length") - F.col("most")) / LIST_BLOCK)).cast("int")
    lists = written(spark, lists.select("shingle", F.col("main"), others.alias("others"), mains.alias("mains")), "join-lists")
    rows = rows.join(small_or_plain(lists, lists.count()), "shingle")
    in_main = (F.col("component") == F.col("main")) & (F.col("mains") > 0)
    number = F.xxhash64("doc_id")
    if whole:
        rows = rows.withColumn("block", F.when(in_main, F.col("others") + F.pmod(number, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(number, F.col("others"))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    else:
        rows = rows.withColumn("block", F.pmod(number, F.col("others") + F.col("mains")).cast("int")).withColumn("other", F.col("block"))
    rows = rows.select("shingle", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "n", "doc_id", "m", "component", "bitmap")
    ordered = rows.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "n", "doc_id")
    keys = ("shingle", "x", "y")

    def found(t: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = _Lists(t, begins, thousandths)
        if whole:
            for i, j in lists.pairs():
                if len(i):
                    # a stands before b in the order of sizes and ids, and so in every list that both are in.
                    yield pa.RecordBatch.from_arrays([pa.array(lists.doc[i]), pa.array(lists.doc[j]), pa.array(np.minimum(lists.m[i], lists.m[j]))], names=["a", "b", "needs"])
        else:
            for own, other, near in lists.nearest():
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(lists.doc[other]), pa.array(lists.doc[own]), pa.array(near)], names=["a", "b", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last list so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            if held and any(held[0].column(c)[0].as_py() != v[0] for c, v in zip(keys, columns, strict=True)):
                yield from found(pa.Table.from_batches(held), np.zeros(1, np.int64))
                held = []
            if not len(new):
                held.append(batch)
                continue
            last = int(new[-1])
            before = sum(h.num_rows for h in held)
            begins = np.concatenate(([0], new[:-1] + before))
            yield from found(pa.Table.from_batches([*held, batch.slice(0, last)]), begins)
            held = [batch.slice(last)]
        if held:
            yield from found(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return ordered.mapInArrow(run, "a long, b long, needs int" if whole else "a long, b long, near double")


def _own_keys(spark: SparkSession, docs: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents and their summaries under keys that stand for one set each.

    A key is the doc_id, but for ids whose rows have different sets: each of these sets has a key of its own.
    Third, (id, key) of those ids; None if there are none.
    """
    several = texts.where("n > 0").groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).where("low <> high")
    several = written(spark, several.select(F.col("doc_id").alias("id")), "join-several")
    count = several.count()
    if not count:
        return docs, texts, None
    several = small_or_plain(several, count)
    sets = texts.where("n > 0").join(several, texts["doc_id"] == several["id"], "left_semi").select(F.col("doc_id").alias("id"), F.col("fingerprint").alias("print")).distinct()
    salt = 0
    while True:
        keys = written(spark, sets.withColumn("key", F.xxhash64("id", "print", F.lit(salt))), "join-keys")
        taken = keys.join(texts.select(F.col("doc_id").alias("key")), "key", "left_semi").count()
        if not taken and keys.select("key").distinct().count() == keys.count():
            break
        salt += 1
    given = small_or_plain(keys, keys.count())
    keyed = texts.join(given, (texts["doc_id"] == given["id"]) & (texts["fingerprint"] == given["print"]), "left")
    keyed = keyed.select(F.coalesce("key", "doc_id").alias("doc_id"), "n", "fingerprint", "bitmap")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in text_slices(batches, "text"):
            own = pa.array([_fingerprint(s) for s in shingle_sets(rows, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), own], names=["doc_id", "text", "own"])

    of_several = docs.join(several, docs["doc_id"] == several["id"], "left_semi").mapInArrow(prints, "doc_id long, text string, own binary")
    of_several = of_several.join(given, (F.col("doc_id") == F.col("id")) & (F.col("own") == F.col("print"))).select(F.col("key").alias("doc_id"), "text")
    others = docs.join(several, docs["doc_id"] == several["id"], "left_anti")
    return others.union(written(spark, of_several, "join-several-texts")), written(spark, keyed, "join-keyed"), keys.select("id", "key")


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two texts link when the shingles that both have are at least ``threshold`` of those that either has;
    component_id is the smallest id reachable by links. See ``shingles`` for words and sets; texts that are
    null or without words have none and link with nothing. A row with a null id links with nothing and has a
    null component; rows that repeat an id are one document with the links of all. Very long texts are taken
    whole. An empty table gives no rows; other columns are ignored.
    """
    thousandths = _percent(threshold)
    summaries = written(spark, _summaries(docs, width), "join-summaries")
    texts = summaries.where("kind = 0").drop("kind")
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, sets, keys = _own_keys(spark, known, texts.where("doc_id is not null"), width)
    # (1) one node for each set
    nodes = written(spark, sets.where("n > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1"), "join-nodes")
    copies = sets.select("doc_id", "fingerprint").join(small_or_plain(nodes, nodes.count()), "fingerprint").where("doc_id <> node").select("doc_id", "node").distinct()
    copies = written(spark, copies, "join-copies")
    dropped = copies.count()
    single = rows.join(small_or_plain(copies.select("doc_id"), dropped), "doc_id", "left_anti") if dropped else rows
    # (2) lists
    met = written(spark, _met(_postings(spark, single, _counted(summaries), width, thousandths), thousandths), "join-met")
    long = met.where("kind = 0").select("shingle", "doc_id", "n", "m")
    in_long = written(spark, long.select("doc_id").distinct(), "join-in-long")
    texts_in_long = in_long.count()
    bitmaps = small_or_plain(_list_bitmaps(_sets(sets, in_long)), LIST_BITS // 64 * texts_in_long)
    long = written(spark, long.join(bitmaps, "doc_id"), "join-long")
    # (3) one link to check for each text of a long list, in each round
    components = None
    for _ in range(MOST_ROUNDS if texts_in_long else 0):
        near = _long_pairs(spark, long, components, thousandths, whole=False).groupBy("b").agg(F.max_by("a", F.struct("near", -F.col("a"))).alias("a"))
        near = written(spark, near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-near")
        links = written(spark, _checked(spark, near, single, width, thousandths), "join-links")
        settled = links.count()
        if components is not None:
            links = links.union(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        components = connected_components(spark, links)
        if settled < SETTLES * texts_in_long:
            break
    # (4) pairs that are still open
    rest = met.where("kind = 1").select(F.col("doc_id").alias("a"), F.col("other").alias("b"), F.col("m").alias("needs"))
    if components is not None:
        rest = rest.union(_long_pairs(spark, long, components, thousandths, whole=True))
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("needs").alias("needs")).where("shared >= needs")
    if components is not None:
        found = small_or_plain(components, components.count())
        for c in "ab":
            rest = rest.join(found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left")
        rest = rest.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b"))
    rest = written(spark, rest.select("a", "b"), "join-open")
    rest = written(spark, _bounded(spark, rest, sets, thousandths), "join-bounded")
    links = _checked(spark, rest, single, width, thousandths)
    if components is not None:
        links = links.union(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
    if keys is None:
        final = connected_components(spark, links)
        out = texts.select("doc_id", F.col("n").alias("n_shingles")).join(small_or_plain(copies, dropped), "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
        return out.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    # Ids of several sets are where these meet; all else is under its own id.
    named = links.union(copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    for c in "ab":
        ids = small_or_plain(keys.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id")), keys.count())
        named = named.join(ids, c, "left").withColumn(c, F.coalesce(f"{c}_id", c)).drop(f"{c}_id")
    final = connected_components(spark, named.select("a", "b"))
    out = texts.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with the same columns.

    Of rows that repeat an id all stay or go. Rows with a null id stay, and so do null texts and those without words, which
    link with nothing. Very long texts are compared whole. An empty table gives no rows. Columns may have any names.
    """
    found = jaccard_components(spark, docs.select("doc_id", "text"), width, threshold)
    gone = written(spark, found.where("doc_id <> component_id").select("doc_id").distinct(), "join-gone")
    rows = gone.count()
    return docs.join(small_or_plain(gone, rows), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
