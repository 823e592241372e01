"""Column builders for scores, probabilities, vectors and counts. Every division is guarded, as Spark's ANSI mode raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.when((b == 0) | b.isNull(), F.lit(default).cast("double")).otherwise(a / F.nullif(b, F.lit(0)))


def smoothed(a: Column, b: Column) -> Column:
    """a / (b + 1)"""
    return a / (b + F.lit(1))


def guarded(a: Column, b: Column) -> Column:
    """a / max(1, b)"""
    return a / F.greatest(F.lit(1.0), b.cast("double"))


def burstiness(mean: Column, std: Column, n: Column) -> Column:
    """(std - mean) / (std + mean); 0 for fewer than 2 gaps (3 points) or where both are 0."""
    return F.when((n < 2) | (mean + std == 0), 0.0).otherwise((std - mean) / F.nullif(std + mean, F.lit(0)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tempered(p: Column, temperature: float, eps: float = 1e-8) -> Column:
    return sigmoid(logit(p, eps) / temperature)


def binary_entropy(p: Column, eps: float = 1e-6) -> Column:
    """Entropy in nats divided by ln 2."""
    p = clip(p, eps, 1 - eps)
    return -(p * F.log(p) + (1 - p) * F.log(1 - p)) / F.log(F.lit(2.0))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-10)))


def mean_of(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols) / len(cols)


def median_of(*cols: Column) -> Column:
    a = F.array_sort(F.array(*cols))
    n = len(cols)
    return F.element_at(a, n // 2 + 1) if n % 2 else (F.element_at(a, n // 2) + F.element_at(a, n // 2 + 1)) / 2


def variance_of(*cols: Column) -> Column:
    m = mean_of(*cols)
    return mean_of(*[(c - m) * (c - m) for c in cols])


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share; 0 to 0 where n is 0."""
    nn = F.greatest(n.cast("double"), F.lit(1.0))
    p = hits / nn
    centre, half = (p + z * z / (2 * nn)) / (1 + z * z / nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    return F.when(n == 0, 0.0).otherwise(F.greatest(centre - half, F.lit(0.0))), F.when(n == 0, 0.0).otherwise(F.least(centre + half, F.lit(1.0)))


def virality_score(velocity: Column, followers: Column, z: Column) -> Column:
    """0.3, plus 0.2 over 100 an hour, plus 0.2 over 10,000 followers, plus 0.15 over z 5; within 0.05 and 0.95."""
    s = F.lit(0.3) + F.when(velocity > 100, 0.2).otherwise(0.0) + F.when(followers > 10000, 0.2).otherwise(0.0) + F.when(z > 5, 0.15).otherwise(0.0)
    return clip(s, 0.05, 0.95)
