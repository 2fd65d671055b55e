"""Portable backups: a folder for each table and a manifest of counts and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, rows long, fingerprint string"


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, fingerprint of a table, whatever the order of its rows: a sum of row hashes, so no task holds the table.

    Floating-point columns count by their bits; equal tables give equal fingerprints.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.coalesce(p, F.lit("0")) for p in parts]).alias("fingerprint"))


def save(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each table and the manifest; the manifest comes last, so a folder without one is no backup."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    listed = None
    for name in tables:
        row = fingerprint(spark.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("table"), "rows", "fingerprint")
        listed = row if listed is None else listed.unionByName(row)
    if listed is None:
        listed = spark.createDataFrame([], MANIFEST)
    listed.coalesce(1).write.json(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """table, rows, ok: whether each table still is what the manifest says."""
    out = None
    for r in spark.read.schema(MANIFEST).json(f"{folder}/manifest").collect():  # a row for each table
        now = fingerprint(spark.read.parquet(f"{folder}/{r['table']}"))
        row = now.select(F.lit(r["table"]).alias("table"), "rows", ((F.col("rows") == r["rows"]) & (F.col("fingerprint") == r["fingerprint"])).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "table string, rows long, ok boolean")


def restore(spark: SparkSession, folder: str, dry_run: bool = True) -> dict[str, DataFrame]:
    """The tables of a backup that verifies; a dry run checks only. One that does not verify is an error."""
    bad = [r["table"] for r in verify(spark, folder).where("NOT ok").collect()]
    if bad:
        raise ValueError(f"the backup's tables {bad} are not what its manifest says")
    names = [r["table"] for r in spark.read.schema(MANIFEST).json(f"{folder}/manifest").collect()]
    return {} if dry_run else {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_json(memories: DataFrame, folder: str) -> None:
    memories.write.json(folder)


def offloaded(rows: DataFrame, text: str = "content", limit: int = 4000) -> DataFrame:
    """rows with bytes and summary; content over the limit is null, to be kept apart under ref."""
    size, ref = F.octet_length(text), F.sha2(text, 256)
    large = size > limit
    return rows.withColumns({"bytes": size, "summary": F.substring(text, 1, 200), "ref": F.when(large, ref), text: F.when(large, F.lit(None)).otherwise(F.col(text))})
