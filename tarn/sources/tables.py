"""Readers and writers: driver tables, and the import formats of memory files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: id, title, content, project, agent_space, layer, confidence, created."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    layer = F.element_at(F.array(*map(F.lit, ("flash", "short", "long", "entity"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), F.col("source").alias("project"), F.col("lang").alias("agent_space"),
        layer.alias("layer"), F.coalesce(F.col("quality").cast("double"), F.lit(0.8)).alias("confidence"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("created"),
    )


def memory_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memories() with what a store keeps of them: hits from events, and status, decay, tags and metadata by rule."""
    hits = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("hit_count"), F.max(F.to_date("ts")).alias("last_hit_at"))
    i = F.col("id")
    tags = F.filter(F.array(F.col("project"), F.when(i % 3 == 0, F.lit("kind:task")), F.when(i % 5 == 0, F.lit("project:alpha")), F.when(i % 7 == 0, F.col("agent_space"))), lambda t: t.isNotNull())
    return memories(spark, sf_dir).join(hits, "id", "left").select(
        "id", "title", "content", "project", "agent_space", "layer", "confidence", "created", F.date_add("created", (i % 30).cast("int")).alias("updated"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "last_hit_at",
        F.when(i % 13 == 0, "archived").otherwise("active").alias("status"), ((i * 37 % 100 + 1) / 100).alias("decay_factor"), F.when(i % 11 != 0, tags).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(i % 4 != 1, F.lit("import")).alias("source"), F.when(i % 6 == 0, F.lit("fact")).alias("kind"), F.when(i % 10 == 0, F.lit('{"associationStatus":"independent"}')).otherwise(F.lit("{}")).alias("metadata"),
    )
