"""URL filter: rules first, then a ratio of two character models.

Addresses that a rule decides train two character models, of accepted and of rejected addresses. Each is a
variable-order Markov model: a character is predicted from the longest context seen often enough, blended
with all shorter ones by the Witten-Bell weights. The difference of the log-likelihoods for each character,
against a threshold calibrated on addresses held back from training, decides the others.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.llm.common import written

# Verdict, host and path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Longest context, fewest times a context must be seen, and training addresses of each class at most (None: all).
ORDER, LEAST_SEEN, TRAINING_ROWS = 5, 4, None
#: Different followers of contexts that a task counts before it gives them out.
COUNTED_AT_ONCE = 500_000
ALPHABET = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?', '#' or the end; else both empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none fits."""
    which = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, h + p).otherwise(which), F.when(fits, v).otherwise(verdict)
    return which, verdict


def followers(address: str, order: int = ORDER) -> Iterator[tuple[str, str]]:
    """Each context of up to ``order`` characters in an address, and the character after it."""
    padded = "\n" * order + address + "\t"
    for i in range(order, len(padded)):
        for k in range(order + 1):
            yield padded[i - k : i], padded[i]


class MarkovModel:
    """Log-probabilities of characters after contexts of up to ``order`` characters."""

    def __init__(self, addresses: list[str], order: int = ORDER, least: int = LEAST_SEEN):
        seen: dict[str, Counter[str]] = defaultdict(Counter)
        for a in addresses:
            for context, c in followers(a, order):
                seen[context][c] += 1
        self._learn(seen, order, least)

    @classmethod
    def counted(cls, seen: dict[str, dict[str, int]], order: int = ORDER, least: int = LEAST_SEEN) -> MarkovModel:
        """The model of addresses in which each context was followed that often by each character."""
        model = cls.__new__(cls)
        model._learn(seen, order, least)
        return model

    def _learn(self, seen: dict[str, dict[str, int]], order: int, least: int) -> None:
        self.order = order
        #: For each context: the weight left to shorter contexts, and the blended probability of each character seen after it.
        self.contexts: dict[str, tuple[float, dict[str, float]]] = {}
        for context in sorted(seen, key=len):
            follow = seen[context]
            total, kinds = sum(follow.values()), len(follow)
            if context and (total < least or context[1:] not in self.contexts):
                continue
            left = kinds / (total + kinds)
            self.contexts[context] = left, {c: n / (total + kinds) + left * (self._probability(context[1:], c) if context else 1 / ALPHABET) for c, n in follow.items()}
        if "" not in self.contexts:
            self.contexts[""] = 1.0, {}

    def _probability(self, context: str, c: str) -> float:
        weight = 1.0
        while True:
            left, follow = self.contexts[context]
            if (p := follow.get(c)) is not None:
                return weight * p
            weight *= left
            if not context:
                return weight / ALPHABET
            context = context[1:]

    def mean_log(self, address: str) -> float:
        padded, total = "\n" * self.order + address + "\t", 0.0
        for i in range(self.order, len(padded)):
            context = padded[i - self.order : i]
            while context not in self.contexts:
                context = context[1:]
            total += log(self._probability(context, padded[i]))
        return total / (len(address) + 1)


class UrlClassifier:
    """Two models and the threshold of their difference: at or above it, an address is accepted."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        fit = [[a for i, a in enumerate(x) if i % 4] or x for x in (accepted, rejected)]
        held = [[a for i, a in enumerate(x) if i % 4 == 0] for x in (accepted, rejected)]
        self.models = [MarkovModel(x) for x in fit]
        scores = sorted([(self.score(a), 1) for a in held[0]] + [(self.score(a), 0) for a in held[1]])
        yes, no = len(held[0]), len(held[1])
        self.threshold = 0.0
        if yes and no:  # least mean of the two error rates
            below_yes, below_no, best = 0, 0, 1.0
            for i, (s, label) in enumerate(scores):
                error = (below_yes / yes + (no - below_no) / no) / 2
                if error < best:
                    best, self.threshold = error, (s + scores[i - 1][0]) / 2 if i else s - 1e-9
                below_yes, below_no = below_yes + label, below_no + 1 - label

    @classmethod
    def of(cls, models: list[MarkovModel], threshold: float) -> UrlClassifier:
        made = cls.__new__(cls)
        made.models, made.threshold = models, threshold
        return made

    def score(self, address: str) -> float:
        return self.models[0].mean_log(address) - self.models[1].mean_log(address)


def _counts(addresses: DataFrame) -> DataFrame:
    """verdict, context, total and follow (character and number) of the contexts in addresses (verdict, address) that are seen often enough, and of the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, str]] = Counter()

        def out() -> pa.RecordBatch:
            columns = zip(*((*k, n) for k, n in seen.items()), strict=True) if seen else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.string()] * 3 + [pa.int64()], strict=True)], names=["verdict", "context", "c", "n"])

        for batch in batches:
            for verdict, address in zip(batch.column("verdict").to_pylist(), batch.column("address").to_pylist(), strict=True):
                seen.update((verdict, *f) for f in followers(address))
                if len(seen) >= COUNTED_AT_ONCE:
                    yield out()
                    seen.clear()
        yield out()

    counted = addresses.select("verdict", "address").mapInArrow(run, "verdict string, context string, c string, n long").groupBy("verdict", "context", "c").agg(F.sum("n").alias("n"))
    contexts = counted.groupBy("verdict", "context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("c", "n")).alias("follow"))
    return contexts.where((F.col("total") >= LEAST_SEEN) | (F.col("context") == ""))


def _in_order(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt to ranges of ``by``, with ``part``, the number of each one's range."""
    return written(rows.sparkSession, rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "url-ranges")


def _examples(decided: DataFrame, most: int | None) -> DataFrame:
    """verdict, address and place (from 0, by hash) of the different addresses of each verdict, all or the first ``most``; one row a range is numbered in a window."""
    rows = _in_order(decided.distinct().withColumn("hash", F.md5(F.col("address").cast("binary"))), "verdict", "hash", "address")
    sizes = rows.groupBy("verdict", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("verdict").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("verdict", "part").orderBy("hash", "address")) - 1
    placed = rows.withColumn("inside", inside).join(F.broadcast(sizes.select("verdict", "part", before.alias("before"))), ["verdict", "part"])
    placed = placed.select("verdict", "address", (F.col("before") + F.col("inside")).alias("place"))
    return written(rows.sparkSession, placed if most is None else placed.where(F.col("place") < most), "url-examples")


def _threshold(scores: DataFrame) -> float:
    """The cut of least mean of the two error rates over verdict and score, the lowest of equals; 0 without scores of both verdicts. Sums go over ranges of scores."""
    side = lambda v: F.count_if(F.col("verdict") == v)
    rows = _in_order(scores.groupBy("score").agg(side("allow").alias("yes"), side("block").alias("no")), "score")
    yes, no = rows.agg(F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0))).first()
    if not yes or not no:
        return 0.0
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = rows.groupBy("part").agg(F.sum("yes").alias("y"), F.sum("no").alias("n"), F.max("score").alias("last"))
    ranges = ranges.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "yn"], F.max("last").over(earlier).alias("last"))
    below = Window.partitionBy("part").orderBy("score")
    upto = lambda c, base: F.col(base) + F.coalesce(F.sum(c).over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = rows.join(F.broadcast(ranges), "part").select("score", F.coalesce(F.lag("score").over(below), "last").alias("last"), upto("yes", "y").alias("y"), upto("no", "n").alias("n"))
    error = (F.col("y") / F.lit(yes) + (F.lit(no) - F.col("n")) / F.lit(no)) / 2
    best = cuts.agg(F.min(F.struct(error.alias("error"), "score", "last")).alias("best")).select("best.*").first()
    if best["error"] >= 1.0:
        return 0.0
    return (best["score"] + best["last"]) / 2 if best["last"] is not None else best["score"] - 1e-9


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, training_rows: int | None = TRAINING_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, llr (the difference for each character) and model_verdict of every url.

    Trained on all different addresses that rules decide, or on at most ``training_rows`` of either verdict, those with the
    smallest hashes; a quarter is held back for the threshold. Without such addresses of both verdicts the models are empty and accept
    everything. What the driver holds are the contexts seen often enough, which grow with the kinds of addresses, not with their number.
    A null url or one without '://' has an empty host and path and is judged as an empty address. Repeated
    rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    which, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", which.alias("rule"), verdict.alias("rule_verdict"))
    address = F.concat("host", "path")
    examples = _examples(rows.where("rule_verdict is not null").select(F.col("rule_verdict").alias("verdict"), address.alias("address")), training_rows)
    sizes = dict(map(tuple, examples.groupBy("verdict").count().collect()))
    seen: dict[str, dict[str, dict[str, int]]] = {"allow": {}, "block": {}}
    trained = len(sizes) == 2
    if trained:
        alone = [v for v, n in sizes.items() if n == 1]  # fitted on what is held back as well
        for r in _counts(examples.where((F.col("place") % 4 > 0) | F.col("verdict").isin(alone))).toLocalIterator():
            seen[r["verdict"]][r["context"]] = {c: n for c, n in r["follow"]}
    models = [MarkovModel.counted(seen[v]) for v in ("allow", "block")]

    def ratio_by(classifier):
        @F.pandas_udf("double")
        def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            judge = classifier.value
            for addresses in batches:
                known = {a: judge.score(a) for a in set(addresses)}
                yield addresses.map(known)

        return ratio

    ratio = ratio_by(spark.sparkContext.broadcast(UrlClassifier.of(models, 0.0)))
    threshold = _threshold(examples.where("place % 4 = 0").select("verdict", ratio("address").alias("score"))) if trained else 0.0
    scored = rows.withColumn("llr", ratio(address)).withColumn("model_verdict", F.when(F.col("llr") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "model_verdict").alias("verdict"), "llr", "model_verdict")
