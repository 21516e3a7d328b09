"""Distances of vectors (arrays of numbers) as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum_of(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum_of(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def distance(metric: str, a: Column, b: Column) -> Column:
    match metric:
        case "cosine":
            return 1 - cosine(a, b)
        case "l2":
            return F.sqrt(_sum_of(a, b, lambda x, y: (x - y) * (x - y)))
        case "l1":
            return _sum_of(a, b, lambda x, y: F.abs(x - y))
        case "neg_ip":
            return -dot(a, b)
    raise ValueError(f"no metric {metric!r}")


#: The metrics' names.
METRICS = ("cosine", "l2", "l1", "neg_ip")
