"""Which functions change together (JN9-JN11, AG7-AG11, WN1, FLT9-FLT14, ML16, JN19).

``touched`` has (commit, node), ``commits`` (commit, ts, author) and optionally ``seq``. Attributes
are joined on the commit key before the self-join on the same key, so both joins use one
shuffle; the window over a pair and the aggregation by the pair share the next one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import day_gap

PAIR = ["func1", "func2"]


#: Touched functions whose pairs one task makes, and pairs that one task counts, in the mean.
TOUCHED_A_TASK, PAIRS_A_TASK = 500_000, 500_000


def pair_events(touched: DataFrame, commits: DataFrame | None = None, max_nodes: int | None = None, dealt: bool = False, touched_a_task: int = TOUCHED_A_TASK, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """JN10: a row for each pair func1 < func2 in a commit, with ts and author (JN9: null where unknown).

    ``max_nodes`` leaves out commits with more distinct nodes; off by default. Commits are dealt into as many partitions as
    their functions take, so that what a task holds does not grow with the input; with ``dealt`` also the pairs, those of two functions
    into one partition. That is for windows and for pairs that seldom recur; few pairs that recur often are better combined first.
    """
    each = touched.where("commit is not null and node is not null").groupBy("commit").agg(F.count("*").cast("double").alias("n"))
    rows, pairs = each.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    parts = lambda n, a_task: math.ceil((n or 0) / a_task)
    deal = lambda df, n, *by: df.repartition(n, *by) if n > 1 else df
    into = parts(rows, touched_a_task)
    seen = deal(touched.select("commit", "node").where("commit is not null and node is not null"), into, "commit").distinct()
    if max_nodes:
        seen = seen.withColumn("_n", F.count("*").over(W.partitionBy("commit"))).where(F.col("_n") <= max_nodes).drop("_n")
    left = seen if commits is None else seen.join(deal(commits.select("commit", "ts", "author", *[c for c in ("seq",) if c in commits.columns]), into, "commit"), "commit", "left")
    a, b = left.alias("a"), seen.alias("b")
    met = a.join(b, (F.col("a.commit") == F.col("b.commit")) & (F.col("a.node") < F.col("b.node")))
    rest = [F.col(f"a.{c}") for c in left.columns if c != "node"]
    met = met.select(F.col("a.node").alias("func1"), F.col("b.node").alias("func2"), *rest)
    return deal(met, parts(pairs, pairs_a_task), *PAIR) if dealt else met


def pair_counts(touched: DataFrame, name: str = "cochange_count") -> DataFrame:
    """AG8: (func1, func2, count) of the commits that touch both."""
    return pair_events(touched, dealt=True).groupBy(*PAIR).agg(F.count("*").alias(name))


def cochange_matrix(touched: DataFrame, commits: DataFrame, arrays: bool = False) -> DataFrame:
    """AG8-AG11: (func1, func2, cochange_count, unique_authors, avg_time_gap, first_ts[, timestamps, authors]).

    A gap (WN1) is counted in whole days from the pair's previous commit that has a time.
    """
    events = pair_events(touched, commits, dealt=True)
    order = ["ts", "seq"] if "seq" in events.columns else ["ts", "commit"]
    past = W.partitionBy(*PAIR).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    events = events.withColumn("gap", day_gap(F.last("ts", ignorenulls=True).over(past), F.col("ts")))
    more = [F.sort_array(F.collect_list("ts")).alias("timestamps"), F.sort_array(F.collect_list("author")).alias("authors")] if arrays else []
    return events.groupBy(*PAIR).agg(
        F.count("*").alias("cochange_count"),
        F.countDistinct("author").alias("unique_authors") if not arrays else F.size(F.collect_set("author")).cast("long").alias("unique_authors"),
        F.avg("gap").alias("avg_time_gap"),
        F.min("ts").alias("first_ts"),
        *more,
    )


def modify_counts(touched: DataFrame) -> DataFrame:
    """AG7: (node, modify_count), a commit counts once."""
    return touched.select("commit", "node").distinct().groupBy("node").agg(F.count("*").alias("modify_count"))


def filter_pairs(
    matrix: DataFrame,
    total: DataFrame | None = None,
    min_cochange: int = 3,
    floor_ratio: float = 0.001,
    max_avg_gap: float = 30,
    min_authors: int = 2,
) -> DataFrame:
    """FLT10, FLT13, FLT14. ``total`` is a one-row frame (total) of the mapped commits, for the floor."""
    keep = (F.col("unique_authors") >= min_authors) & (F.coalesce("avg_time_gap", F.lit(0.0)) <= max_avg_gap)
    if total is None:
        return matrix.where(keep & (F.col("cochange_count") >= min_cochange))
    least = F.greatest(F.lit(min_cochange), F.floor(total.select("total").scalar() * F.lit(floor_ratio)).cast("int"))
    return matrix.where(keep & (F.col("cochange_count") >= least))


def total_commits(touched: DataFrame) -> DataFrame:
    """One row: commits with at least one mapped function."""
    return touched.where("node is not null").agg(F.countDistinct("commit").alias("total"))


def filter_hubs(pairs: DataFrame, counts: DataFrame, total: DataFrame, max_modify_ratio: float = 0.2) -> DataFrame:
    """FLT12: drops pairs with a side that changes in more than its share of all commits; adds both counts."""
    side = lambda k: counts.select(F.col("node").alias(f"func{k}"), F.col("modify_count").alias(f"func{k}_modify_count"))
    both = pairs.join(side(1), "func1", "left").join(side(2), "func2", "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("func1_modify_count", "func2_modify_count")})
    limit = total.select("total").scalar() * F.lit(max_modify_ratio)
    return both.where((F.col("func1_modify_count") <= limit) & (F.col("func2_modify_count") <= limit))


def positive_pairs(
    touched: DataFrame,
    commits: DataFrame,
    distances: DataFrame,
    min_cochange: int = 3,
    max_distance: int = 3,
    max_modify_ratio: float = 0.2,
    min_authors: int = 2,
    max_avg_gap: float = 30,
    floor_ratio: float = 0.001,
    strict_distance: bool = False,
) -> DataFrame:
    """ML16. Cheap filters come first; only survivors meet the distances (func1, func2, distance).

    Pairs without a distance count as -1 and stay unless ``strict_distance``.
    """
    total = total_commits(touched)
    few = filter_pairs(cochange_matrix(touched, commits), total, min_cochange, floor_ratio, max_avg_gap, min_authors)
    few = filter_hubs(few, modify_counts(touched), total, max_modify_ratio)
    near = few.join(distances.select(*PAIR, "distance"), PAIR, "left").withColumn("distance", F.coalesce("distance", F.lit(-1)))
    keep = ~(F.col("distance") > max_distance)
    return near.where(keep & (F.col("distance") >= 0) if strict_distance else keep)


def file_cochange(touched: DataFrame) -> DataFrame:
    """JN19: (func1, func2, cochange_count) of the distinct files of each commit."""
    return pair_events(touched).groupBy(*PAIR).agg(F.count("*").alias("cochange_count"))


def multi_file_commits(changes: DataFrame, least: int = 2) -> DataFrame:
    """FLT8: (commit, n_files) of commits that touch at least ``least`` distinct files of ``changes`` (commit, path)."""
    return changes.groupBy("commit").agg(F.countDistinct("path").alias("n_files")).where(F.col("n_files") >= least)
