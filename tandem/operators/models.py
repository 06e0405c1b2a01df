"""Boosted trees on pair features, and predictions (ML11-ML13, FLT15, GR8, SET2)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Settings of the single-project and of the joint model.
SINGLE = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
JOINT = SINGLE | {"stepSize": 0.1}


def _ready(df: DataFrame) -> DataFrame:
    return df.withColumn("_x", array_to_vector("features"))


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than the cluster runs at once. Each level of each tree sends its bins from every partition
    through a shuffle, whatever the rows of a partition, so more of them add to that and to nothing else."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def train(df: DataFrame, balanced: bool = True, **settings) -> Model:
    """ML11: (features, label) to a model; positives weigh as much as there are negatives for each of them."""
    data, extra = _ready(df.select("features", F.col("label").cast("double").alias("label"))), {}
    if balanced:
        c = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
        data = data.withColumn("_w", F.when(F.col("label") == 1, float(c["n"]) / c["p"] if c["p"] else 1.0).otherwise(1.0))
        extra = {"weightCol": "_w"}
    return GBTClassifier(featuresCol="_x", labelCol="label", **(SINGLE | settings), **extra).fit(gathered(data))


def train_joint(projects: dict[str, DataFrame], **settings) -> Model:
    """ML12, SET2: one model over all projects, without class weights."""
    return train(union_projects(projects), balanced=False, **(JOINT | settings))


def union_projects(projects: dict[str, DataFrame]) -> DataFrame:
    """SET2: rows of all projects with their project's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("project", F.lit(k)) for k, df in projects.items()])


def predict(model: Model, df: DataFrame, score: str = "score") -> DataFrame:
    """ML13: ``df`` with the positive class's probability."""
    out = model.transform(_ready(df)).withColumn(score, vector_to_array("probability")[1])
    return out.select(*df.columns, score)


def threshold_edges(scored: DataFrame, threshold: float, a: str = "func1", b: str = "func2", score: str = "score") -> DataFrame:
    """FLT15, GR8: undirected edges (src <= dst, weight) of the pairs at or above the threshold."""
    return scored.where(F.col(score) >= threshold).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col(score).alias("weight"))
