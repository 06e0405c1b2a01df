"""Source text (SC7, SC8, JN2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(code: Column, start: Column, end: Column) -> Column:
    """SC7: lines start..end, counted from 1; '' if the span leaves the text."""
    lines = F.split(code, "\n")
    inside = (start > 0) & (end <= F.size(lines)) & (end >= start)
    return F.when(inside, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")).otherwise("")


def line_at(text: Column, offset: Column) -> Column:
    """SC8: line number of a 0-based offset."""
    return 1 + F.length(F.substring(text, F.lit(1), offset)) - F.length(F.replace(F.substring(text, F.lit(1), offset), F.lit("\n"), F.lit("")))


def mentions_line(diff: Column, start: Column, end: Column) -> Column:
    """JN2: whether the number of some line of the span occurs in the diff's text."""
    return F.exists(F.sequence(start, F.greatest(start, end)), lambda n: F.contains(diff, n.cast("string"))) & (end >= start)
