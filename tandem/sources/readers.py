"""Readers of trees and artefacts (SRC3-SRC8, SRC12-SRC19). Formats and defaults are settled here, so operators see one schema.

JSON artefacts that are one document are read whole, a row a file; large ones belong in Parquet,
which every reader takes as well (a path whose files end in .parquet, or any folder).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension, in_skipped_folder, language
from . import schemas


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC3, SRC4, FLT2-FLT5: (path, language, code) of a tree's source files; paths are relative to ``root``.

    Names are filtered before any content is read; undecodable bytes are dropped; blank files are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    top = root.rstrip("/").split("://")[-1]
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.ltrim(F.substring(full, F.instr(full, top) + len(top), F.length(full)), F.lit("/"))
    f = raw.select(rel.alias("path"), "content").withColumn("language", language(F.col("path")))
    f = f.where(F.col("language").isNotNull() & (extension(F.col("path")) != "") & ~in_skipped_folder(F.col("path")))
    # try_validate_utf8 alone would drop a file with one bad byte; make_valid_utf8 marks bad bytes, which then go.
    code = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return f.select("path", "language", code.alias("code")).where(F.col("code").rlike(r"\S"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: one row a commit, from a JSON array or Parquet."""
    if path.endswith(".json"):
        return spark.read.schema(schemas.COMMIT).json(path, multiLine=True)
    return spark.read.parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (node_id, ...) from a JSON map keyed by node id, or Parquet."""
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schemas.METADATA_MAP)).alias("node_id", "m")).select("node_id", "m.*")


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SRC8: (nodes, edges)."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC14, SRC15: (split, func1, func2, label, metadata fields). From JSON the test split is ``test_pairs`` where
    there is one, else ``test``; a file with neither is an error."""
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", f"struct<{schemas.LABELS.replace(' array', ':array')}>").alias("d"), "value").select("d.*")
    test = F.coalesce("test_pairs", "test")
    if doc.where(test.isNull()).limit(1).count():
        raise ValueError(f"{path} has neither test_pairs nor test")
    each = F.array(*[F.struct(F.lit(k).alias("split"), v.alias("pairs")) for k, v in (("train", F.col("train")), ("val", F.col("val")), ("test", test))])
    rows = doc.select(F.explode(each).alias("s")).select("s.split", F.explode("s.pairs").alias("p"))
    return rows.select("split", "p.func1", "p.func2", "p.label", "p.metadata.*")


def evolution(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC16, E22: (node, modify_count, authors, commit_times); values may be numbers or objects; no path means no rows."""
    shape = "node string, modify_count int, authors array<string>, commit_times array<string>"
    if path is None:
        return spark.createDataFrame([], shape)
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("node", "v"))
    obj = F.from_json("v", f"struct<{schemas.EVOLUTION}>")
    number = F.col("v").try_cast("double").cast("int")
    return raw.select("node", F.coalesce(number, obj["modify_count"], F.lit(0)).alias("modify_count"), obj["authors"].alias("authors"), obj["commit_times"].alias("commit_times"))


def commit_to_functions(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC17: distinct (commit, node); no path means no rows."""
    if path is None:
        return spark.createDataFrame([], "commit string, node string")
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("commit", "nodes")).select("commit", F.explode("nodes").alias("node")).distinct()


def function_features(spark: SparkSession, path: str) -> DataFrame:
    """SRC12."""
    return spark.read.parquet(path)


def pair_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC13: one split is one partition of the table."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def embedding_cache(spark: SparkSession, path: str | None) -> DataFrame | None:
    """SRC18."""
    return None if path is None else spark.read.parquet(path)


def model(path: str):
    """SRC19: a saved classifier or pipeline."""
    try:
        return GBTClassificationModel.load(path)
    except Exception as e:  # noqa: BLE001 - the metadata names another class
        if "class name" not in str(e):
            raise
        return PipelineModel.load(path)
