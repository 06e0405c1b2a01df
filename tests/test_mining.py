"""Micro-fixtures with expected values worked out by hand; ids in brackets are operators."""

import math
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.operators import mining, ordering

COMMITS = [("c1", datetime(2024, 1, 1), "A"), ("c2", datetime(2024, 1, 11, 12), "B"), ("c3", datetime(2024, 1, 31), "A")]
TOUCHED = [("c1", "f1"), ("c1", "f2"), ("c2", "f1"), ("c2", "f2"), ("c2", "f3"), ("c3", "f1"), ("c3", "f2"), ("c3", "f2")]


def frames(spark):
    return spark.createDataFrame(TOUCHED, "commit string, node string"), spark.createDataFrame(COMMITS, "commit string, ts timestamp, author string")


def test_matrix(spark):
    """JN9 JN10 AG8 AG9 AG10 AG11 WN1."""
    rows = {(r.func1, r.func2): r for r in mining.cochange_matrix(*frames(spark)).collect()}
    assert set(rows) == {("f1", "f2"), ("f1", "f3"), ("f2", "f3")}
    r = rows["f1", "f2"]
    assert (r.cochange_count, r.unique_authors, r.avg_time_gap, r.first_ts) == (3, 2, 14.5, datetime(2024, 1, 1))
    assert rows["f1", "f3"].avg_time_gap is None and rows["f1", "f3"].cochange_count == 1


def test_matrix_arrays(spark):
    r = mining.cochange_matrix(*frames(spark), arrays=True).where("func1 = 'f1' and func2 = 'f2'").first()
    assert r.timestamps == sorted(c[1] for c in COMMITS) and r.authors == ["A", "A", "B"]


def test_unknown_times_count_but_leave_no_gap(spark):
    touched, commits = frames(spark)
    commits = commits.withColumn("ts", F.when(F.col("commit") != "c2", F.col("ts")))
    r = mining.cochange_matrix(touched, commits).where("func1 = 'f1' and func2 = 'f2'").first()
    assert r.cochange_count == 3 and r.avg_time_gap == 30


def test_positive_filter(spark):
    """ML16 FLT10-FLT14."""
    touched, commits = frames(spark)
    none = spark.createDataFrame([], "func1 string, func2 string, distance int")
    keep = lambda ratio: mining.positive_pairs(touched, commits, none, 3, 3, ratio, 2, 30).collect()
    assert [(r.func1, r.func2, r.distance) for r in keep(1.0)] == [("f1", "f2", -1)]
    assert keep(0.1) == []
    far = spark.createDataFrame([("f1", "f2", 4)], none.schema)
    assert mining.positive_pairs(touched, commits, far, 3, 3, 1.0, 2, 30).count() == 0
    assert mining.positive_pairs(touched, commits, none, 3, 3, 1.0, 2, 30, strict_distance=True).count() == 0


def test_modify_counts(spark):
    """AG7."""
    assert {r.node: r.modify_count for r in mining.modify_counts(frames(spark)[0]).collect()} == {"f1": 3, "f2": 3, "f3": 1}


def test_max_nodes(spark):
    assert mining.pair_events(frames(spark)[0], max_nodes=2).count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6)), max_size=25))
def test_pairs_are_all_two_sets(spark, rows):
    df = spark.createDataFrame(rows, "commit int, node int")
    got = mining.pair_events(df).collect()
    sizes = {}
    for c, n in set(rows):
        sizes[c] = sizes.get(c, 0) + 1
    assert len(got) == sum(math.comb(n, 2) for n in sizes.values())
    assert all(r.func1 < r.func2 for r in got)


def test_splits(spark):
    """WN4 ML19 ML20 ST9."""
    pairs = [(f"a{i}", f"b{i}", 1, f"2024-01-{i + 1:02d}") for i in range(7)] + [(f"x{i}", f"y{i}", 0, None) for i in range(10)]
    df = spark.createDataFrame(pairs, "func1 string, func2 string, label int, first_ts string")
    s = ordering.temporal_split(df)
    n = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert n == {(1, "train"): 4, (1, "val"): 1, (1, "test"): 2, (0, "train"): 6, (0, "val"): 2, (0, "test"): 2}
    assert {r.func1 for r in s.where("label = 1 and split = 'train'").collect()} == {"a0", "a1", "a2", "a3"}
    r = ordering.random_split(df).groupBy("split").count()
    assert {x.split: x["count"] for x in r.collect()} == {"train": 10, "val": 3, "test": 4}
    assert ordering.quota(5, 2.5) == (12, 6)


def test_recent(spark):
    """ST2 ST3."""
    c = frames(spark)[1]
    assert [r.commit for r in ordering.newest(c, 2).collect()] == ["c3", "c2"]
    seq = c.withColumn("seq", F.col("commit"))
    assert ordering.first_commits(seq, 0).count() == 3 and [r.commit for r in ordering.first_commits(seq, 1).collect()] == ["c1"]


def test_pairs_are_dealt_by_their_number(spark):
    """JN10 AG8: partitions grow with the touched functions and the pairs, and the rows stay the same."""
    rows = [(c, n) for c in range(40) for n in range(c % 9)] + [(1, None), (None, 3), (8, 2)]
    df = spark.createDataFrame(rows, "commit int, node int")
    plain = sorted(map(tuple, mining.pair_events(df).collect()))
    made = mining.pair_events(df, dealt=True, touched_a_task=10, pairs_a_task=8)
    assert sorted(map(tuple, made.collect())) == plain and len(plain) == sum(math.comb(c % 9, 2) for c in range(40))
    assert made.rdd.getNumPartitions() >= len(plain) // 8
    got = {(r.func1, r.func2): r.cochange_count for r in mining.pair_counts(df).collect()}
    assert got == {(a, b): sum((x, y) == (a, b) for x, y, _ in plain) for a, b, _ in plain}
