"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join on the node, so a node with many
neighbours is split by Spark's skew handling; edges stay as many as the links given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours above it (large), or those below and itself, to the smallest of them and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node): a row for every node in links (a, b: long).

    Self links and repeated links do no harm; nodes without links get no row; an
    empty table gives an empty result.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        edges = written(_star(_star(edges, large=True), large=False), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
