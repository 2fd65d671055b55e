"""Approximate nearest neighbours: a small-world graph per shard, answers merged.

Equal vectors are one point that names its smallest ids, so copies cannot crowd a
graph. Points are dealt by hash to shards, but where lengths differ by their length: in a
graph of all lengths the long points are neighbours of all others, and a search for the
largest inner product does not leave them; in a range of lengths it does. A shard's graph is one row of flat arrays in
the shared folder. Shards grow with the square root of the table up to a bound, as a
search costs little more in a large graph than in a small one: what a query costs grows
with the number of shards. Query vectors go to every shard in blocks, and the shards'
answers are merged in two rounds of grouping.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, written
from tarn.llm.hnsw import M, Graph

GROWTH, MOST_POINTS, MOST_BYTES = 64, 1 << 16, 1 << 28  # points of a shard: GROWTH * sqrt(all), at most so many or so large
SPREAD, STRIPES = 1.05, 3  # where lengths differ by more, from the 5th to the 95th percentile, there are so many times as many shards
BLOCK_QUERIES = 4096
INDEX = "part int, dim int, vectors binary, ids binary, counts binary, points binary, numbers binary, near array<binary>"


def usable(vec: Column) -> Column:
    """Not null, no component null or non-finite, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _smallest(lists: Column, n: int) -> Column:
    return F.slice(F.sort_array(lists), 1, n)


def _key(vec: Column) -> Column:
    """The vector's length, and a millionth of it by hash, which parts vectors of equal length."""
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return length * (1 + F.pmod(F.xxhash64(vec), F.lit(1 << 20)) / float(1 << 20) * 1e-6)


def shards_of(n: int, dim: int) -> int:
    """How many shards n vectors have."""
    points = max(256, min(GROWTH * math.isqrt(n), MOST_POINTS, MOST_BYTES // (8 * dim)))
    return -(-n // points)


def _gathered(frames):
    """A partition's frames by dim and part: a partition holds few shards, each of bounded size."""
    held: dict[tuple[int, int], list[pd.DataFrame]] = {}
    for frame in frames:
        for key, own in frame.groupby(["dim", "part"]):
            held.setdefault(key, []).append(own)
    while held:
        key, own = held.popitem()
        yield *key, pd.concat(own)


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per shard: the distinct vectors, each with its k smallest ids, and their graph."""
    valid = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    local = valid.groupBy("vec", F.spark_partition_id().alias("task")).agg(_smallest(F.collect_set("id"), k).alias("ids"))
    points = written(local.groupBy("vec").agg(_smallest(F.array_distinct(F.flatten(F.collect_list("ids"))), k).alias("ids")).withColumn("dim", F.size("vec")), "vectors")
    spark, placed = points.sparkSession, points.withColumn("key", _key(F.col("vec")))
    first, hashed, striped = 0, [], {}
    # there are as many rows here as lengths of vectors; a number for each shard, those of a dimension in a row
    for r in placed.groupBy("dim").agg(F.count("*").alias("n"), F.percentile_approx("key", [0.05, 0.95], 1000).alias("ends")).collect():
        shards = shards_of(r["n"], r["dim"])
        if r["ends"][1] > SPREAD * r["ends"][0]:
            shards *= STRIPES
            cuts = placed.where(F.col("dim") == r["dim"]).agg(F.percentile_approx("key", [i / shards for i in range(1, shards)], max(10_000, 50 * shards))).first()[0]
            striped[r["dim"]] = (first, np.array(cuts))
        else:
            hashed.append((r["dim"], first, shards))
        first += shards

    @F.pandas_udf("int")
    def stripe(dim: pd.Series, key: pd.Series) -> pd.Series:
        out = np.zeros(len(dim), np.int32)
        for d, (base, cuts) in striped.items():
            own = (dim == d).to_numpy()
            out[own] = base + np.searchsorted(cuts, key.to_numpy()[own], "right")
        return pd.Series(out)

    by_hash = placed.join(F.broadcast(spark.createDataFrame(hashed, "dim int, base int, shards int")), "dim")
    by_hash = by_hash.select("dim", (F.col("base") + F.pmod(F.xxhash64("vec"), F.col("shards"))).cast("int").alias("part"), "vec", "ids")
    by_norm = placed.where(F.col("dim").isin([*striped])).select("dim", stripe("dim", "key").alias("part"), "vec", "ids")
    placed = by_hash.unionByName(by_norm) if striped else by_hash

    def build(frames):
        for dim, part, own in _gathered(frames):
            raw = np.stack(own["vec"].to_numpy()).astype(np.float64)
            graph = Graph.build(raw)
            yield pd.DataFrame([{
                "part": part, "dim": dim, "vectors": raw.tobytes(), "ids": np.concatenate(own["ids"].to_numpy()).astype("<i8").tobytes(), "counts": own["ids"].map(len).to_numpy("<i8").tobytes(),
                "points": graph.points.tobytes(), "numbers": graph.order.astype("<i8").tobytes(), "near": [x.tobytes() for x in graph.near],
            }])

    # each shard is a task of its own
    return written(placed.repartitionById(max(1, first), F.col("part")).mapInPandas(build, INDEX), "index")


def _blocks(frames):
    held: dict[int, list[pd.DataFrame]] = {}
    for frame in frames:
        for dim, own in frame.groupby("dim"):
            held.setdefault(dim, []).append(own)
    for dim, parts in held.items():
        own = pd.concat(parts)
        for i in range(0, len(own), BLOCK_QUERIES):
            part = own.iloc[i : i + BLOCK_QUERIES]
            yield pd.DataFrame([{"dim": dim, "queries": part["query"].to_numpy(np.int64).tobytes(), "targets": np.stack(part["vec"].to_numpy()).astype(np.float64).tobytes()}])


def _answers(frames, k: int, width: int | None):
    for frame in frames:
        for row in frame.itertuples():
            vectors, counts = np.frombuffer(row.vectors).reshape(-1, row.dim), np.frombuffer(row.counts, "<i8")
            ids, ends = np.frombuffer(row.ids, "<i8"), np.append(np.cumsum(counts), 0)
            near = [np.frombuffer(x, np.int32).reshape(-1, M if i else 2 * M) for i, x in enumerate(row.near)]
            graph = Graph(np.frombuffer(row.points, np.float32).reshape(len(vectors) + 1, -1), np.frombuffer(row.numbers, "<i8"), near)
            targets, queries = np.frombuffer(row.targets).reshape(-1, row.dim), np.frombuffer(row.queries, "<i8")
            found = graph.search(targets, k, width or max(4 * k, int(10 * math.log2(len(vectors) + 1))))
            out = []
            for i in range(0, len(found), 512):  # bounded memory
                block = found[i : i + 512]
                score = np.einsum("bkd,bd->bk", vectors[block], targets[i : i + 512])
                for q, points, values in zip(queries[i : i + 512], block, score, strict=True):
                    pairs = sorted((-v, x) for p, v in zip(points.tolist(), values.tolist(), strict=True) if p >= 0 for x in ids[ends[p] - counts[p] : ends[p]].tolist())[:k]
                    out.append((q, row.part % 64, [{"nearness": s, "id": x} for s, x in pairs]))
            yield pd.DataFrame(out, columns=["query", "task", "found"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, width: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, without its own id.

    width: how many points a search keeps in view, by default as the shard's size asks.
    Nearness is the largest inner product, in double precision on the vectors as given;
    ties go to the smaller id. Vectors null, zero or with null or non-finite components,
    and rows with a null id, take no part; vectors of different lengths never meet. A
    query with fewer candidates gets all of them. Rows that repeat a query's id each get
    its answers; candidates that repeat an id and a vector count once. Empty tables give an empty result. Other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    most = k + 1  # one of them may be the query's own row
    index = build_index(vectors, most, id_col, vec_col)
    asked = queries.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    distinct = written(asked.groupBy("vec").agg(F.min("id").alias("query")).withColumn("dim", F.size("vec")), "queries")
    blocks = distinct.repartition(distinct.count() // BLOCK_QUERIES + 1, "query").mapInPandas(_blocks, "dim int, queries binary, targets binary")
    shards = index.select("dim", "part")
    # queries travel to the shards: a shard's row moves once
    sent = blocks.join(F.broadcast(shards), "dim")
    met = sent.drop("dim").join(index.hint("shuffle_hash"), "part")
    answers = met.mapInPandas(lambda it: _answers(it, most, width), "query long, task int, found array<struct<nearness: double, id: long>>")
    for keys in (["query", "task"], ["query"]):
        answers = answers.groupBy(*keys).agg(_smallest(F.flatten(F.collect_list("found")), most).alias("found"))
    rows = asked.join(distinct, "vec").select("id", "query").join(answers, "query")
    own = F.filter("found", lambda x: x["id"] != F.col("id"))
    return rows.select("id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit")).select(
        F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.nearness")).alias("score")
    )
