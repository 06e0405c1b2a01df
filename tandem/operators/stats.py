"""Repository statistics (AG1-AG6, ST4, AG25-AG27, SC18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..functions.times import month


def commit_totals(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """AG1, AG2: one row of totals. ``changes`` has (commit, added, deleted) for each changed file; authors count by email."""
    c = commits.agg(F.count("*").alias("total_commits"), F.countDistinct("author").alias("total_authors"))
    f = changes.agg(F.count("*").alias("total_files_changed"), F.sum("added").alias("total_added_lines"), F.sum("deleted").alias("total_deleted_lines"))
    return c.crossJoin(f)


def monthly_activity(changes: DataFrame, ts: str = "ts") -> DataFrame:
    """AG4: changed files by month."""
    return changes.groupBy(month(F.col(ts)).alias("month")).agg(F.count("*").alias("n"))


def by_extension(paths: DataFrame, path: str = "path") -> DataFrame:
    """AG3: files by lower-case extension; those without one are left out."""
    return paths.select(extension(F.col(path)).alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count("*").alias("n"))


def function_modifications(changes: DataFrame, file: str = "file", name: str = "name") -> DataFrame:
    """AG5: by 'file#function'."""
    return changes.groupBy(F.concat_ws("#", file, name).alias("func")).agg(F.count("*").alias("n"))


def top(df: DataFrame, k: int, key: str, n: str = "n") -> DataFrame:
    """ST4: the k largest counts, ties by key."""
    return df.orderBy(F.desc(n), key).limit(k)


def static_statistics(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """AG6: one row over (node_id, file_path, class_name, arg_count, size) and (src, dst)."""
    f = functions.agg(
        F.count("*").alias("total_functions"),
        F.countDistinct("file_path").alias("total_files"),
        F.countDistinct(F.when(F.col("class_name").isNotNull(), F.concat_ws("::", "file_path", "class_name"))).alias("total_classes"),
        F.round(F.avg("arg_count"), 2).alias("avg_args"),
        F.round(F.avg("size"), 2).alias("avg_size"),
    )
    return f.crossJoin(edges.agg(F.count("*").alias("total_edges")))


def by_language(functions: DataFrame) -> DataFrame:
    return functions.groupBy("language").agg(F.count("*").alias("n"))


def label_statistics(pairs: DataFrame) -> DataFrame:
    """AG16, AG25, FLT17: for each split its pairs, positives, negatives, their ratio and the positive rate."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return pairs.groupBy("split").agg(
        F.count("*").alias("total_pairs"),
        pos.alias("positive_pairs"),
        neg.alias("negative_pairs"),
        F.round(F.coalesce(F.try_divide(neg, pos), F.lit(1.0)), 6).alias("class_ratio"),
        F.round(F.avg("label"), 6).alias("positive_rate"),
    )


def coverage(mapped: DataFrame, node: str = "node_id") -> DataFrame:
    """AG14, AG27: functions found and unmapped, and the share found (0 if there are none)."""
    found, missing = F.count_if(F.col(node).isNotNull()), F.count_if(F.col(node).isNull())
    return mapped.agg(found.alias("found"), missing.alias("unmapped"), F.round(F.coalesce(F.try_divide(found, found + missing), F.lit(0.0)), 6).alias("coverage"))
