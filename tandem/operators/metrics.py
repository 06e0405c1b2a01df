"""Ranking and classification metrics (AG15-AG22, ST8, SC18, FLT16, FLT22, ML15), exact and without a global sort.

Everything cumulative is computed over distinct scores: rows are first counted by score, which
combines before the shuffle and leaves as many rows as there are distinct scores.
Running sums over those go by coarse score bucket first, then within the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import ranks
from .state import settle


def _bucket(score: Column) -> Column:
    """Falls as the score rises; a thousandth wide."""
    return F.floor(-1000 * score)


def by_score(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, tp, fp, n_pos, n_neg): counts at or above each distinct score, and the score's own."""
    d = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) != 1).alias("n_neg"))
    d = settle(d.withColumn("_b", _bucket(F.col("score"))))  # scores may come from a model: they are computed once
    sums = d.groupBy("_b").agg(F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = W.partitionBy("_b").orderBy(F.desc("score"))
    j = d.join(sums, "_b")
    return j.select("score", (F.col("_p") + F.sum("n_pos").over(inside)).alias("tp"), (F.col("_n") + F.sum("n_neg").over(inside)).alias("fp"), "n_pos", "n_neg")


def auc_roc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """AG19, WN6: one row; pairs of a positive above a negative, ties half. Null without both classes."""
    d = by_score(df, score, label)
    # At each score its positives beat every negative below it: all negatives minus those at or above.
    t = d.agg(
        F.sum("n_pos").alias("p"),
        F.sum("n_neg").alias("n"),
        F.sum(F.col("n_pos").cast("double") * (F.col("fp") - F.col("n_neg") / 2.0)).alias("lost"),
    )
    return t.select(F.round(F.try_divide(F.col("p").cast("double") * F.col("n") - F.col("lost"), F.col("p").cast("double") * F.col("n")), 6).alias("auc_roc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """AG20: the step-wise sum of precision over recall."""
    d = by_score(df, score, label)
    t = d.agg(F.sum(F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("n_pos").alias("p"))
    return t.select(F.round(F.try_divide("s", "p"), 6).alias("avg_precision"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """AG22: (threshold, precision, recall, f1) at every distinct score; f1 null where it is not defined."""
    d = by_score(df, score, label)
    total = df.agg(F.count_if(F.col(label) == 1)).scalar()
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), total)
    d = d.select(F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    return d.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_f1(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """AG22, ST15: the threshold of the highest f1, the lowest of equals."""
    c = pr_curve(df, score, label).where("f1 is not null").withColumn("f1", F.round("f1", 9))
    m = c.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"), "precision", "recall")).alias("m"))
    return m.select(F.round(-F.col("m.t"), 6).alias("threshold"), F.round("m.f1", 6).alias("f1"), F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"))


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """AG17, AG18, FLT16: one row of counts with precision, recall and f1, 0 where not defined."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & ~true).alias("tn"), F.count_if(~hit & true).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.withColumn("f1", f1).withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


def classification_report(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """AG21: precision, recall, f1 and support of both classes, their mean and their mean by support."""
    c = confusion(df, threshold, score, label).select("tp", "fp", "tn", "fn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    row = lambda name, hit, false, miss: F.struct(
        F.lit(name).alias("class"), ratio(hit, hit + false).alias("precision"), ratio(hit, hit + miss).alias("recall"), ratio(2 * hit, 2 * hit + false + miss).alias("f1"), (hit + miss).alias("support")
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    each = c.select(F.explode(F.array(row("0", tn, fn, fp), row("1", tp, fp, fn))).alias("r")).select("r.*")
    names = ("precision", "recall", "f1")
    macro = each.agg(*[F.avg(x).alias(x) for x in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = each.agg(*[F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return each.unionByName(macro).unionByName(weighted).withColumns({x: F.round(x, 6) for x in names})


def precision_at_k(df: DataFrame, ks: Sequence[int] = (50, 100, 200, 500), score: str = "score", label: str = "label", key: str = "id") -> DataFrame:
    """ST8, WN5, FLT22: (k, precision, recall) in order of score, ties by key; k beyond the rows are left out. A top-k, not a sort."""
    top = df.orderBy(F.desc(score), key).limit(max(ks)).withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))
    total = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    hits = top.agg(*[F.count_if((F.col("rank") <= k) & (F.col(label) == 1)).alias(f"h{k}") for k in ks])
    one = hits.crossJoin(total).select("n", "p", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks])).alias("x"))
    return one.where("x.k <= n").select("x.k", F.round(F.col("x.h") / F.col("x.k"), 6).alias("precision"), F.round(F.try_divide("x.h", "p"), 6).alias("recall"))


def distribution(df: DataFrame, score: str = "score", cuts: Sequence[float] = (0.1, 0.3, 0.5, 0.7)) -> DataFrame:
    """AG15: one row. The median is read from the ranks around the middle, each taken from its bucket."""
    r = ranks(df.select(F.col(score).alias("score")).where("score is not null"), ["score"], F.floor(1000 * F.col("score")))
    middle = r.where((2 * F.col("rank") >= F.col("n")) & (2 * F.col("rank") <= F.col("n") + 2)).agg(F.avg("score").alias("median_score"))
    s = df.agg(
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.round(F.stddev_pop(score), 6).alias("std_score"),
        *[F.count_if(F.col(score) > c).alias(f"above_{int(c * 100)}") for c in cuts],
    )
    return s.crossJoin(middle.select(F.round("median_score", 6).alias("median_score")))


def tier(value: Column) -> Column:
    """SC18."""
    return F.when(value > 0.8, "excellent").when(value > 0.7, "good").when(value > 0.6, "fair").otherwise("poor")


def evaluate(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """ML15: one row with the areas, the confusion counts, the ratios and the tier."""
    one = auc_roc(df, score, label).crossJoin(average_precision(df, score, label)).crossJoin(confusion(df, threshold, score, label))
    return one.withColumn("tier", tier(F.col("auc_roc")))
