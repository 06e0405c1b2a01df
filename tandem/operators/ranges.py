"""Lines to functions and classes (JN1-JN5, WN3).

Every join has equality keys: the file, with the commit where there is one, and the stretch of
lines. The interval is a residual of a hash-partitioned join, never a product, and a file with
many functions compares a line only with those of its stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Lines in a stretch. Spans are posted under each stretch that they touch, lines under their own.
STRETCH = 16


def _posted(spans: DataFrame, low: Column, high: Column) -> DataFrame:
    first, last = F.floor(low / STRETCH), F.floor(high / STRETCH)
    return spans.withColumn("_s", F.explode(F.when(last >= first, F.sequence(first, last))))


def _meet(lines: DataFrame, spans: DataFrame, keys: Sequence[str], inside: Column) -> Column:
    on = (lines["_s"] == spans["_s"]) & inside
    for k in keys:
        on = on & (lines[k] == spans[k])
    return on


def first_enclosing(lines: DataFrame, spans: DataFrame, keys: Sequence[str], line: str = "line", how: str = "left") -> DataFrame:
    """JN1, JN4, JN5: each row of ``lines`` with the first span (lowest ``seq``) of the same keys whose
    start_line..end_line holds it; the outermost wins. The first is taken by an aggregation on the join's
    own partitions, not by sorting a file's matches. Lines that come with further columns are looked up once each."""
    if set(lines.columns) > {*keys, line}:
        once = first_enclosing(lines.select(*keys, line).distinct(), spans, keys, line, how)
        return lines.join(once, [*keys, line], how).select(*[lines[c] for c in lines.columns], "span")
    rest = [c for c in spans.columns if c not in keys]
    s = _posted(spans, F.col("start_line"), F.col("end_line")).select(*keys, "_s", F.struct("seq", *[c for c in rest if c != "seq"]).alias("span"))
    at = lines.withColumn("_s", F.floor(F.col(line) / STRETCH))
    inside = (F.col(line) >= F.col("span.start_line")) & (F.col(line) <= F.col("span.end_line"))
    joined = at.join(s, _meet(at, s, keys, inside), how).select(*[at[c] for c in lines.columns], "span")
    return joined.groupBy(*lines.columns).agg(F.min("span").alias("span"))


def enclosing_band(lines: DataFrame, spans: DataFrame, keys: Sequence[str], band: int = 1, line: str = "line") -> DataFrame:
    """JN3: for each span its lines within start-band..end+band, sorted and distinct."""
    low, high = F.col("start_line") - band, F.col("end_line") + band
    s = _posted(spans, low, high)
    at = lines.select(*keys, F.col(line).alias("_line"), F.floor(F.col(line) / STRETCH).alias("_s"))
    joined = s.join(at, _meet(at, s, keys, (F.col("_line") >= low) & (F.col("_line") <= high)))
    return joined.select(*[s[c] for c in spans.columns], "_line").groupBy(*spans.columns).agg(F.sort_array(F.collect_set("_line")).alias("lines"))


def affected_functions(functions: DataFrame) -> DataFrame:
    """SET7: one row for each name:start-end of a commit's file."""
    return functions.dropDuplicates([c for c in ("commit", "file_path", "name", "start_line", "end_line") if c in functions.columns])
