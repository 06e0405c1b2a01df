"""Arrays as vectors (SC15, SC24, ML8, ML10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def pair_vector(v1: Column, v2: Column, e1: Column, e2: Column, dim: int) -> Column:
    """ML8: both sides, their absolute difference and product, three zeros, two evolution counts.
    A missing side zeroes the whole block of 4 * dim."""
    a, b = v1.cast("array<double>"), v2.cast("array<double>")
    block = F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))
    tail = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.coalesce(e1, F.lit(0)).cast("double"), F.coalesce(e2, F.lit(0)).cast("double"))
    return F.concat(F.when(v1.isNull() | v2.isNull(), zeros(4 * dim)).otherwise(block), tail)


def standardize(v: Column, mean: Column, std: Column) -> Column:
    """ML10; a spread of zero divides by one."""
    shifted = F.zip_with(v, mean, lambda x, m: x - m)
    return F.zip_with(shifted, std, lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))
