"""Numbers: vectors, ranks, confidence and trust."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
#: The floor of confidence for agents when none or no valid one is set.
TRUST_FLOOR = 0.8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def clamp_confidence(c: Column) -> Column:
    """In [0, 1]; what isn't a number is 0."""
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def two_decimals(c: Column) -> Column:
    """A confidence, which is a float, to the nearest hundredth; what lies in the middle goes to the even one, as C has it.
    A float times 100 is exact in double precision."""
    return F.rint(c.cast("float").cast("double") * 100) / 100


def trust_floor(value: float | None) -> float:
    return value if value is not None and not math.isnan(value) and 0 <= value <= 1 else TRUST_FLOOR


def trust_status(actor_type: Column, actor_id: Column, confidence: Column, whitelist: list[str] | None, floor: float | None = None) -> Column:
    """active for humans, and for listed agents that are confident enough; else proposed."""
    listed = actor_id.isin(*whitelist) if whitelist else F.lit(False)
    trusted = (actor_type == "agent") & listed & (confidence >= F.lit(trust_floor(floor)))
    return F.when((actor_type == "human") | trusted, "active").otherwise("proposed")
