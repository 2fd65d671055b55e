"""Cutting lineage by a checkpoint in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there.

    The folder is spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    one; a cluster has no safe default, so it must set one.
    """
    folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a compressed table beside the checkpoints and read from there: for what is large, or read by columns."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """Where this application's checkpoints are."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarn-"))
    return context.getCheckpointDir().rstrip("/")


FEW = 1 << 20  # rows of a broadcast table of ids


def few(rows: DataFrame) -> DataFrame:
    """rows (ids or numbers), by broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in Arrow batches of at most 8 MB, unless the session has its own limit: Spark's 64 MB is meant for narrow rows."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(8 << 20))
