"""Vector functions over array columns, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if an element is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; null elements if it has none."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance_similarity(c: Column) -> Column:
    """What an index that squares distances twice reports for the cosine ``c``."""
    d = 2 - 2 * c
    return 1 - d * d / 2


def maxsim(a: Column, b: Column) -> Column:
    """Late interaction of two token matrices: for each token of ``a`` its best product in ``b``, averaged, clamped to 0..1, both ways."""
    one = lambda x, y: F.aggregate(F.transform(x, lambda u: F.array_max(F.transform(y, lambda v: dot(u, v)))), F.lit(0.0), lambda s, m: s + m) / F.size(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (one(a, b) + one(b, a)) / 2))
