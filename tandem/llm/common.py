"""What the text operators share: the shared folder, safe column picks, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import forget, release, settle, ship

__all__ = ["forget", "release", "settle"]

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` has it.
SPACE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows in one Arrow batch. Texts may be very long; a batch of whole texts has to fit a worker.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def join_ids(big: DataFrame, ids: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Joins texts or other large rows with few rows of ids and flags. The ids are counted first: up to
    ``BROADCAST_ROWS`` they go to the large side, which is not shuffled; beyond, both sides meet by hash."""
    ids = settle(ids)
    return big.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, how)


def small_batches(spark: SparkSession) -> None:
    """Readies the session for the operators that hand whole texts to Python: the package goes to the
    workers, and an Arrow batch holds few rows."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows of whole numbers. They go as Arrow: of a plain list ``createDataFrame`` makes an RDD, for which each executor
    starts Python workers of another kind beside those of the maps, and keeps them."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, columns)}), schema)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a one-element ``transform`` binds it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def all_of(columns: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out
