"""A corpus pipeline of five stages, each calling one operator.

``run`` applies the stages to ``documents``; the last one says how many copies of a document
the mix takes. Between stages the rows are written as Parquet below the shared folder, so a
lost executor costs one stage at most.

Null or empty texts fall at the quality stage; an empty table runs through to an empty result;
columns beside those of ``documents`` are carried along. Rows are told apart by id, text, language and
source, so rows that share an id, or have none, are judged each by its own text; of
rows that are equal in all four, and of near copies, one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import decontaminate, mixing, quality_rules, simhash, toxicity
from tandem.llm.common import settle, table, unused


def row_key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text", "lang", "source")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut. Nothing is measured on labels here, so no labelled row is held out."""
    score = unused(docs, "_score")
    # Passed on, not kept: the driver is free of the model once it is broadcast.
    scored = toxicity.add_score(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), hold=None), name=score)
    return scored.where(F.col(score) < toxicity.CUT).drop(score)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distance reject."""
    return quality_rules.judge(docs, carry=True).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row: one with its smallest id, null ids last. A component is known by its root, not by an
    id, which other components may share. The texts are shuffled once: the semi join and
    the choice among equal rows go by the same key."""
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, row_key())
    found = simhash.near_duplicates(keyed, carry_col=key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "carry"))
    stay = found.groupBy("root").agg(first.alias("first")).select(F.col("first.carry").alias(key))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with a word taken, all their columns, and how often each is repeated. Of the mix's
    figures one whose name a column has already gets underscores before it."""
    mixed = mixing.mix(docs, carry=True).where("taken > 0")
    return mixed.select("row.*", *[F.col(c).alias(unused(docs, c)) for c in ("size", "source_size", "target", "taken", "copies")])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The stages train models and follow links, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
