"""What lives outside a plan: tables that cut lineage, and the package on the executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once a context, so that Arrow maps can
    import it wherever the driver was started and whatever the executors have installed."""
    context = spark.sparkContext
    if getattr(context, "_tandem_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tandem-")) / "tandem.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(path))
    context._tandem_shipped = True


def shared_base(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``, else its checkpoint directory. Only a local
    master may do without: there a temporary folder serves, which on a cluster no other machine would see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="tandem-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` into a new folder below the shared one and reads it back. What comes before runs once, and a lost
    executor repeats none of it."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table of a settled ``df`` that nothing will read again, such as the last round's of an iteration."""
    path = getattr(df, "_settled", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release() -> None:
    """Gives back to the machine what Arrow and the C library keep of freed memory, in this process: the driver's or a worker's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
