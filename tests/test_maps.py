from pyspark.sql import functions as F

from tandem.functions import maps
from tandem.operators import ordering, stats


def test_maps(spark):
    """SC14 SC20."""
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, None)], "m map<string,int>, o map<string,int>")
    assert [r.x for r in df.select(maps.get(F.col("m"), "b", 9).alias("x")).collect()] == [2, 9]
    assert df.select(maps.update(F.col("m"), F.col("o")).alias("x")).first().x == {"a": 1, "b": 3}
    assert spark.range(7, 8).select(maps.part(F.col("id"), 0.6).alias("x")).first().x == 4


def test_preview_and_coverage(spark):
    """ST16 AG14 AG27."""
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "node_id string, x int")
    assert [r.node_id for r in ordering.preview(df, F.desc("node_id"), n=2).collect()] == ["c", "b"]
    assert tuple(stats.coverage(df.select(F.when(F.col("x").isNotNull(), F.col("node_id")).alias("node_id"))).first()) == (2, 1, 0.666667)
    assert tuple(stats.coverage(df.where("false")).first()) == (0, 0, 0.0)
