"""Maps (SC20) and whole-number ratios (SC14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(m: Column, key, default) -> Column:
    """The key's value, or ``default`` where the map or the key is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def update(m: Column, other: Column) -> Column:
    """Both maps' entries; of a key in both the second one's value."""
    keep = F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(other), k))
    return F.map_concat(keep, other)


def part(n: Column, ratio: float) -> Column:
    """SC14: n * ratio, cut off to a whole number."""
    return (n * F.lit(ratio)).cast("int")
