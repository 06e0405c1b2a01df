"""Reproducible orders, quotas and splits (ST1-ST3, ST9-ST14, WN4, ML19, ML20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .state import settle

SEED = 42


def pair_key(a: Column, b: Column, seed: int = SEED) -> Column:
    """ST10: the order key of a pair, the same for both ways round."""
    x, y = a.cast("string"), b.cast("string")
    return F.md5(F.concat_ws("|", F.least(x, y), F.greatest(x, y), F.lit(str(seed))))


def canonical(df: DataFrame, a: str = "func1", b: str = "func2") -> DataFrame:
    """ST14: the smaller of the two first."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def newest(commits: DataFrame, n: int, ts: str = "ts", key: str = "commit") -> DataFrame:
    """ST2: the n most recent commits; ties by key. A top-k, never a full sort."""
    return commits.orderBy(F.col(ts).desc_nulls_last(), F.col(key)).limit(n)


def first_commits(commits: DataFrame, n: int | None, seq: str = "seq") -> DataFrame:
    """ST3: the first n at the scan; None or 0 takes all."""
    return commits.orderBy(seq).limit(n) if n else commits


def preview(df: DataFrame, *order: Column | str, n: int = 5) -> DataFrame:
    """ST16: the first rows in a stated order."""
    return df.orderBy(*order).limit(n)


def ranks(df: DataFrame, order: Sequence[Column | str], bucket: Column, by: str = "rank", groups: Sequence[str] = ()) -> DataFrame:
    """Adds the 1-based rank in ``order`` within ``groups`` and the group's size ``n``.

    ``bucket`` is a value that never falls along the order, such as the order key's first
    characters. Rows are ranked inside their bucket, and the sizes of the buckets before are
    added, so no single task sees all rows; only the bucket sizes are summed in one place. The
    rows are read twice, so they are settled first: what makes them may be costly.
    """
    df = settle(df.withColumn("_bucket", bucket))
    rows = df.withColumn("_local", F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy(*order)))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = df.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(W.partitionBy(*groups)))
    out = rows.join(sizes.drop("_n"), [*groups, "_bucket"])
    return out.withColumn(by, F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def split_of(rank: Column, n: Column, train: float = 0.6, val: float = 0.2) -> Column:
    """WN4: the split of a 1-based rank among n; boundaries are cut off to whole numbers."""
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    return F.when(rank <= first, "train").when(rank <= second, "val").otherwise("test")


def temporal_split(pairs: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = SEED) -> DataFrame:
    """ML19: positives by their earliest time, negatives in hashed order, each cut by the same ratios."""
    key = pair_key(F.col("func1"), F.col("func2"), seed)
    time = F.when(F.col("label") == 1, F.coalesce(F.col("first_ts").cast("string"), F.lit(""))).otherwise("")
    ranked = ranks(pairs.withColumn("_t", time).withColumn("_k", key), ["_t", "_k", "func1", "func2"], F.concat(F.rpad(F.substring("_t", 1, 7), 7, " "), F.when(F.col("_t") == "", F.substring("_k", 1, 2)).otherwise("")), "rank", ["label"])
    return ranked.withColumn("split", split_of(F.col("rank"), F.col("n"), train, val)).drop("_t", "_k")


def random_split(pairs: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = SEED) -> DataFrame:
    """ML20: all pairs in hashed order."""
    ranked = ranks(pairs.withColumn("_k", pair_key(F.col("func1"), F.col("func2"), seed)), ["_k", "func1", "func2"], F.substring("_k", 1, 2))
    return ranked.withColumn("split", split_of(F.col("rank"), F.col("n"), train, val)).drop("_k")


def quota(n_positive: int, ratio: float) -> tuple[int, int]:
    """ST9: how many negatives, and how many of them may be hard ones."""
    target = int(n_positive * ratio)
    return target, target // 2
