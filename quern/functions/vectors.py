"""Vector and probability expressions on array columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, shifted by the maximum."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def log_softmax(scores: Column) -> Column:
    """Logarithms of `softmax`, stable for scores far apart."""
    top = F.array_max(scores)
    total = F.ln(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(scores, lambda x: x - top - total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def difference_code(v: Column) -> Column:
    """64-bit code: bit i (first is highest) is set if element i exceeds its cyclic right neighbour."""
    n = F.size(v)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(F.when(F.get(v, i) > F.get(v, F.pmod(i + 1, n)), 1).otherwise(0).cast("long")))


def shot_fusion_weight(shots: Column, transition: float = 6.0, slope: float = 1.5, one_floor: float = 0.9, low_floor: float = 0.65) -> Column:
    """Weight of the transport branch by training shots: falls with shots, floored for classes of one and of up to four."""
    base = 1 / (1 + F.pow(shots / transition, F.lit(slope)))
    return F.when(shots <= 1, F.greatest(base, F.lit(one_floor))).when(shots <= 4, F.greatest(base, F.lit(low_floor))).otherwise(base)
