"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length, in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size).otherwise(0.0)


def unit(v: Column) -> Column:
    """Scaled to length 1; shorter vectors than 1e-9 stay."""
    return F.when(norm(v) > 1e-9, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(doubles(v))
