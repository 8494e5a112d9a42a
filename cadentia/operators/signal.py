"""Signal conditioning over (clip, idx): windows of one partitioning and order, so all steps share one exchange."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadentia.functions.scalars import clamp

GAUSS_TAPS, GAUSS_SIGMA = 11, 3.0


def by_sample() -> WindowSpec:
    return Window.partitionBy("clip").orderBy("idx")


def whole_clip() -> WindowSpec:
    return Window.partitionBy("clip")


def gauss_weights(taps: int = GAUSS_TAPS, sigma: float = GAUSS_SIGMA) -> list[float]:
    raw = [exp(-((k - (taps - 1) / 2) ** 2) / (2 * sigma * sigma)) for k in range(taps)]
    return [w / sum(raw) for w in raw]


def strided(s: DataFrame, stride: int) -> DataFrame:
    return s.where(F.col("idx") % stride == 0)


def clipped(s: DataFrame, start: float, length: float) -> DataFrame:
    """Samples from ``start`` up to but without start + length."""
    return s.where((F.col("t") >= start) & (F.col("t") < start + length))


def difference(s: DataFrame, value: str = "v", out: str = "diff") -> DataFrame:
    """Absolute change to the sample before, at the later one; the first sample of a clip goes."""
    return s.withColumn(out, F.abs(F.col(value) - F.lag(value).over(by_sample()))).where(F.col(out).isNotNull())


def gauss(s: DataFrame, value: str = "v", out: str = "smooth") -> DataFrame:
    """Weighted sum over neighbours; samples beyond either end count as zero."""
    weights, half = gauss_weights(), GAUSS_TAPS // 2
    total = None
    for k, w in enumerate(weights):
        at = k - half
        x = F.col(value) if at == 0 else F.coalesce((F.lead if at > 0 else F.lag)(value, abs(at)).over(by_sample()), F.lit(0.0))
        total = F.lit(w) * x if total is None else total + F.lit(w) * x
    return s.withColumn(out, total)


def box(s: DataFrame, taps: int, value: str = "v", out: str = "box") -> DataFrame:
    """Sum over neighbours through the fixed number of taps; samples beyond either end count as zero."""
    half = taps // 2
    return s.withColumn(out, F.sum(value).over(by_sample().rowsBetween(-half, half)) / taps)


def snr(s: DataFrame, short: int = 7, long: int = 151) -> DataFrame:
    return box(box(s, short, out="near"), long, out="background").withColumn("snr", F.col("near") / (F.col("background") + 1e-6))


def normalised(s: DataFrame, value: str = "smooth", out: str = "e", low: float = 0.10, high: float = 0.95) -> DataFrame:
    """Scaled so that the two exact percentiles of the clip become 0 and 1, and clamped."""
    p = s.withColumn("_p", F.percentile(value, F.array(F.lit(low), F.lit(high))).over(whole_clip()))
    scaled = (F.col(value) - F.col("_p")[0]) / (F.col("_p")[1] - F.col("_p")[0] + 1e-6)
    return p.withColumn(out, clamp(scaled)).drop("_p")


def conditioned(s: DataFrame) -> DataFrame:
    return normalised(gauss(s))


def fused(s: DataFrame, table: str, pairs: list[tuple[str, str]], out: str = "v") -> DataFrame:
    """Largest of the table's signal and of each other one where its gate is open."""
    return s.withColumn(out, F.greatest(F.col(table), *[F.when(F.col(gate), F.col(v)).otherwise(0.0) for v, gate in pairs]))
