"""Column functions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, or 0 where d is not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def minutes_seconds(t: Column) -> Column:
    """MM:SS, cut off to whole seconds; minutes may exceed 59."""
    whole = F.floor(t).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def review_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "auto").when(confidence >= 0.60, "review").otherwise("block")


def needs_review(winner: Column, confidence: Column) -> Column:
    return (winner == "unknown") | (review_bucket(confidence) != "auto")


def label_of(text: Column) -> Column:
    """player_a before player_b wherever they occur in a text, else unknown."""
    plain = F.lower(F.trim(text))
    return F.when(F.contains(plain, F.lit("player_a")), "player_a").when(F.contains(plain, F.lit("player_b")), "player_b").otherwise("unknown")


def resolved_winner(winner: Column, policy: str = "player_a") -> Column:
    """What an unknown winner becomes: player_a or player_b; 'skip' leaves null, to be filtered."""
    return F.when(winner != "unknown", winner).otherwise(F.lit(None if policy == "skip" else policy))


def point_id(ordinal: Column) -> Column:
    return F.format_string("pt_%04d", ordinal)


def score_pair(text: Column) -> Column:
    """'A-B' as a struct of two integers; raises on anything else."""
    ok = text.rlike(r"^\s*\d+\s*-\s*\d+\s*$")
    part = lambda k: F.trim(F.split(text, "-")[k]).cast("int")
    return F.when(ok, F.struct(part(0).alias("a"), part(1).alias("b"))).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a score: "), text)))


def rational(text: Column, default: float = 30.0) -> Column:
    """'n/d' as a number; the default where d is 0 or the text is no rational."""
    n, d = (F.try_cast(F.get(F.split(text, "/"), F.lit(k)), "double") if hasattr(F, "try_cast") else F.get(F.split(text, "/"), F.lit(k)).try_cast("double") for k in (0, 1))
    return F.coalesce(F.when(d != 0, n / d), F.lit(default))


def sets_required(best_of: Column) -> Column:
    """Sets to win; raises if best_of is not positive and odd."""
    ok = (best_of > 0) & (best_of % 2 == 1)
    return F.when(ok, F.floor(best_of / 2) + 1).otherwise(F.raise_error(F.lit("best_of must be a positive odd number"))).cast("int")


def refined_path(path: Column) -> Column:
    return F.replace(path, F.lit("_draft.json"), F.lit("_refined.json"))


def with_flag(flags: Column, flag: str) -> Column:
    return F.when(F.array_contains(flags, flag), flags).otherwise(F.array_append(flags, F.lit(flag)))


def compression_ratio(nose_y: Column, hip_y: Column, height: Column) -> Column:
    """(hip - nose) / height, 1 where the height is not positive or a point is missing (zero or null)."""
    seen = (height > 0) & (nose_y > 0) & (hip_y > 0)
    return F.when(F.coalesce(seen, F.lit(False)), (hip_y - nose_y) / height).otherwise(1.0)


def is_low(compression: Column, most: float = 0.39) -> Column:
    """Whether a player crouches, by the compression ratio of the pose."""
    return compression < most


def sample_times(base: Column, n: int = 6, step: float = 2.0) -> Column:
    """The first n times at which a clip is looked at, from base on and never before its start; six at most."""
    return F.array(*[F.greatest(F.lit(0.0), base) if k == 0 else base + k * step for k in range(min(n, 6))])


def shown_float(x: Column) -> Column:
    """A double as texts of errors show it: shortest digits, with a point, and an exponent only below 0.0001 and from 10^16 on."""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.get(F.split(text, "E"), F.lit(1)).try_cast("int")
    short = F.concat(F.regexp_replace(F.get(F.split(text, "E"), F.lit(0)), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(power)))
    return F.when(~F.contains(text, F.lit("E")), text).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(short)
