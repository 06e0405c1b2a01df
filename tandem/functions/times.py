"""Commit times: kept as strings, parsed beside (SC11-SC13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """SC12: ISO 8601 with 'Z' or an offset; null where it does not parse."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_gap(earlier: Column, later: Column) -> Column:
    """SC13: whole elapsed days, rounded down (negative if the order is reversed)."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(seconds / F.lit(86_400_000_000)).cast("long")
