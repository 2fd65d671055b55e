"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster has no
    safe default, so it must set one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tarn-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in Arrow batches of at most 8 MB, unless the session has its own limit.

    Texts come in thousands to a batch, and JVM and Python each hold several batches at a
    time; Spark's default of 64 MB is meant for narrow rows.
    """
    if spark.conf.get(ARROW_BYTES, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, str(8 << 20))


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes between steps."""
    return f"{shared_folder(spark).rstrip('/')}/tarn/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete what this application wrote between steps; results that still read it are to be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back.

    The files survive lost executors, and the rows are the same at every later use. They
    stay until forget() or whoever owns the folder removes them.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_IDS = 1 << 20  # 16 MB as a hash relation; more ids than that are joined by a shuffle


def without_dropped(rows: DataFrame, judged: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id some row of judged (id_col, kept) keeps, with all their columns.

    What goes is usually a small part, so its ids travel to the rows, by broadcast where
    their counted number is small; the rows themselves are not shuffled then.
    """
    gone = judged.groupBy(id_col).agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select(id_col)
    gone = written(gone, "dropped")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, rows[id_col].eqNullSafe(gone[id_col]), "left_anti")


def owners(spark: SparkSession) -> int:
    """How many tasks share the work of an exchange by hash."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_KEPT: dict = {}


def kept(key: tuple, make):
    """What a Python worker keeps from task to task: one thing at a time.

    Workers are reused by all operators of a session, so what one operator remembers
    (an encoder, a vocabulary) is let go when another asks for its own.
    """
    if key not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
