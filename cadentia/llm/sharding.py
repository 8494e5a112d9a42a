"""Contiguous sharding with the smallest possible largest shard.

Equal texts form one atomic group; groups are ordered by the MD5 digest of their text, which spreads them
evenly whatever the ids are. The smallest capacity for which a greedy left-to-right fill needs no more
than the given number of shards is found by binary search, and the cuts are placed under it.

Only bounded summaries reach the driver: sums of blocks of the ordered groups (at most 65,536), and the
inside of the few blocks in which a cut may fall, opened level by level until the cut is exact. A document
learns its shard by comparing its digest with the cuts, so no text is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.llm.common import written

#: Hex digits of the digest that name a first block, and that each further level adds.
FIRST_DIGITS, MORE_DIGITS = 4, 2
#: A block of so many groups or fewer is opened group by group.
OPEN_AT_ONCE = 256
#: Rows of a shard are numbered in so many independent parts.
SLOT_PARTS = 256


class _Line:
    """The ordered groups as far as they have been opened; each item is a block or a single group."""

    def __init__(self, items: list[tuple[str, int, int, int]]):
        self.items = sorted(items)
        self.ends = list(accumulate(x[1] for x in self.items))
        self.total = self.ends[-1] if self.ends else 0
        self.largest = max((x[2] for x in self.items), default=0)

    def begin(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def fill(self, capacity: int, shards: int) -> tuple[int, set[int]]:
        """Greedy fill with blocks taken as divisible: bytes placed, and the blocks that a cut would divide."""
        at, divided = 0, set()
        for _ in range(shards):
            reach = at + capacity
            i = bisect_right(self.ends, reach)
            if i >= len(self.ends):
                return self.total, divided
            if self.items[i][3] > 1:
                if self.begin(i) < reach:
                    divided.add(i)
                at = max(self.begin(i), reach)
            else:
                at = self.begin(i)
        return at, divided

    def capacity(self, shards: int) -> tuple[int, set[int]]:
        low, high = max(self.largest, -(-self.total // shards)), max(self.total, 0)
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards)[0] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low, self.fill(low, shards)[1]

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """First item of each shard after the first, and the blocks to open before they hold.

        Every cut lies where both the shard and what follows keep to the capacity; within that range it
        is put nearest to an even share of the bytes left, so a huge group does not leave later shards empty.
        """
        n, starts, latest = len(self.items), [], [0] * (shards + 1)
        latest[0], need = n, set()
        for left in range(1, shards + 1):  # earliest item from which `left` shards suffice
            end = self.begin(latest[left - 1]) if latest[left - 1] < n else self.total
            latest[left] = bisect_left([0, *self.ends], end - capacity, 0, latest[left - 1] + 1) if latest[left - 1] else 0
        i = 0
        for left in range(shards, 1, -1):
            begun = self.begin(i) if i < n else self.total
            most = bisect_right(self.ends, begun + capacity)
            aim = begun + (self.total - begun) / left
            j = bisect_left(self.ends, aim)
            if j < n and self.items[j][3] > 1:
                need.add(j)
            best = j + 1 if j < n and self.ends[j] - aim < aim - self.begin(j) else j
            i = min(max(best, latest[left - 1], i), max(most, i), n)
            starts.append(i)
        return starts, need


def _blocks(groups: DataFrame, digits: int) -> DataFrame:
    return groups.groupBy(F.substring("group_key", 1, digits).alias("prefix")).agg(F.sum("group_size").alias("size"), F.max("group_size").alias("largest"), F.count("*").alias("n"))


def _opened(spark: SparkSession, groups: DataFrame, line: _Line, which: set[int]) -> _Line:
    """The line with some blocks replaced by what is inside them."""
    inside: list[tuple[str, int, int, int]] = []
    wanted: dict[tuple[int, int], list[str]] = {}
    for i in which:
        prefix, _, _, n = line.items[i]
        wanted.setdefault((len(prefix), 32 if n <= OPEN_AT_ONCE else min(32, len(prefix) + MORE_DIGITS)), []).append(prefix)
    for (digits, deeper), prefixes in wanted.items():
        few = groups.where(F.substring("group_key", 1, digits).isin(prefixes))
        inside += [tuple(r) for r in _blocks(few, deeper).collect()]
    return _Line([x for i, x in enumerate(line.items) if i not in which] + inside)


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (place in
    the shard, gapless from 0) and grown_shard (null). A null text counts as empty and groups with empty
    texts; null and repeated ids are rows like others; an empty table gives no rows; other columns of the
    input are ignored. Ties of the digest cannot be told from equal texts (128 bits).
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    slim = written(
        spark,
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = written(spark, slim.groupBy("group_key").agg(F.sum("size").alias("group_size")), "shard-groups")
    line = _Line([tuple(r) for r in _blocks(groups, FIRST_DIGITS).collect()])
    while True:
        capacity, divided = line.capacity(shards)
        if not divided:
            starts, divided = line.cuts(capacity, shards)
        if not divided:
            break
        line = _opened(spark, groups, line, divided)
    bounds = [line.items[i][0] if i < len(line.items) else "g" for i in starts]  # "g" is after every digest
    where = sum((F.when(F.col("group_key") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    placed = slim.withColumn("shard", where.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(SLOT_PARTS)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "group_key"))
    # At most shards * SLOT_PARTS rows.
    return placed.withColumn("own", own).join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
