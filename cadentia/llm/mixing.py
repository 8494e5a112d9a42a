"""Mixing sources to target weights.

Every document has a hash-random key. A source's share of the mix is a whole number of epochs over all its
documents and a cut through the next epoch: documents are taken in the order of their keys until the exact
budget of words is reached. Prefix sums are taken over key ranges first and over single documents only
inside the one range that the cut falls in, so no source is ever sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.llm.common import small_or_plain, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the key that name a range of keys: 4,096 ranges for each source.
RANGE_DIGITS = 3


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary"))


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Water filling over one row a source: target = least(most * size, level * weight), the level such that the targets add up.

    The level follows from prefix sums in the order of size / weight: the sources that reach their limit are
    a prefix of it.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_code_point) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = everything.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)).alias("spent"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))).alias("weight_left"),
        (F.lit(float(share)) * F.sum("source_size").over(all_rows)).alias("wanted"),
    )
    # If this row and all later ones shared what is left, would this row stay under its limit?
    level = (F.col("wanted") - F.col("spent")) / F.col("weight_left")
    filled = filled.withColumn("level", F.when(level < F.col("ratio"), level))
    first = F.first("level", ignorenulls=True).over(all_rows)
    return filled.select("source", "source_size", F.when(first.isNull() | (F.col("ratio") <= first), F.col("limit")).otherwise(first * F.col("weight")).alias("target"))


def _plan(spark: SparkSession, slim: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row a source: source, source_size, target, epochs, cut_key, cut_each. See ``mix``."""
    ranges = written(spark, slim.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = _targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = written(spark, targets, "mix-targets")
    # The range that the cut falls in, and what is left to take inside it.
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = ranges.withColumn("before", before).alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source"))
    near = near.where("rest > before and rest <= before + range_size").select("t.source", "range", (F.col("rest") - F.col("before")).alias("left"))
    inside = slim.alias("s").join(small_or_plain(near, targets.count()).alias("n"), F.expr("s.source <=> n.source and substring(s.key, 1, %d) = n.range" % RANGE_DIGITS))
    inside = inside.groupBy("s.source", "key", "left").agg(F.sum("size").alias("key_size"), F.count("*").alias("key_rows"))
    earlier = F.coalesce(F.sum("key_size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("earlier", earlier).where("left > earlier and left <= earlier + key_size")
    cut = cut.select("source", F.col("key").alias("cut_key"), F.expr("(left - earlier) div key_rows").alias("cut_each"))
    joined = targets.alias("t").join(cut.alias("c"), F.expr("t.source <=> c.source"), "left")
    return joined.select("t.source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_each", F.lit(0)).alias("cut_each"))


def _decided(spark: SparkSession, slim: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, int]:
    plan = written(spark, _plan(spark, slim, weights, share, most), "mix-plan")
    return plan, plan.count()


_TAKEN = "epochs * size + case when key < cut_key then size when key = cut_key then least(size, cut_each) else 0 end"
_COPIES = "epochs + case when key < cut_key or key = cut_key and cut_each > 0 then 1 else 0 end"


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words of every document the mix takes.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all words; no
    target exceeds ``most`` times its source, and what a limit cuts off goes to the others by weight. Returns
    doc_id, source, size, source_size, target, taken and copies (times that the document appears, the last
    one maybe in part). Words are runs of characters other than space and 0x09-0x0D; a null text has none.
    Null sources are one source; null ids share one key. Rows of a source with one key (repeated ids) that
    the cut falls on share its words evenly. Texts of any length are counted whole. An empty table gives no rows. Other columns are ignored.
    """
    slim = written(spark, docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(F.col("doc_id"), seed).alias("key")), "mix-rows")
    plan, rows = _decided(spark, slim, weights, share, most)
    joined = slim.alias("s").join(small_or_plain(plan, rows).alias("p"), F.expr("s.source <=> p.source"))
    return joined.select("doc_id", "s.source", "size", "source_size", "target", F.expr(_TAKEN).cast("long").alias("taken"), F.expr(_COPIES).cast("int").alias("copies"))


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix as whole rows with the columns of ``docs``: each appears as often as the mix takes it, the one at a cut whole.

    Null and empty texts have size 0; a null source is a source, the last one; rows that repeat an id share its key and are
    taken or left together. An empty table gives no rows. Columns may have any names.
    """
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), word_count(F.col("text")).alias("size"))
    keyed = keyed.select("row", "source", "size", _key(F.col("doc_id"), seed).alias("key"))
    slim = written(spark, keyed.select("source", "size", "key"), "mix-rows")
    plan, rows = _decided(spark, slim, weights, share, most)
    joined = keyed.alias("s").join(small_or_plain(plan, rows).alias("p"), F.expr("s.source <=> p.source"))
    copies = F.explode(F.array_repeat(F.lit(0), F.expr(_COPIES).cast("int")))
    return joined.select("row", copies.alias("copy")).select("row.*")


ORACLE = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, 'null') || ':{SEED}') as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (
  select *, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 2.0::double * source_size as lim from s),
f as (
  select *, lim / weight as ratio, coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as spent,
         sum(weight) over () - coalesce(sum(weight) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weight_left,
         1.5::double * sum(source_size) over () as wanted from w),
v as (
  select min(case when (wanted - spent) / weight_left < ratio then (wanted - spent) / weight_left end) filter (where rn = first_rn) as level
  from (select *, min(case when (wanted - spent) / weight_left < ratio then rn end) over () as first_rn
        from (select *, row_number() over (order by ratio, source nulls last) as rn from f))),
t as (
  select source, source_size, case when level is null or ratio <= level then lim else level * weight end as target from f, v),
e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
c as (
  select d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs,
         round(e.target - e.epochs * e.source_size)::bigint as rest,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as earlier
  from d join e on d.source is not distinct from e.source)
select doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - earlier)))::bigint as taken,
       (epochs + case when rest > earlier and (rest - earlier >= size or rest - earlier > 0) then 1 else 0 end)::int as copies
from c
"""
