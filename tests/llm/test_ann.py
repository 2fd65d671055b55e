import numpy as np
from pyspark.sql import functions as F

from tarn.llm import ann
from tarn.llm.hnsw import Graph


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        score = vectors @ vectors[list(ids).index(q)]
        order = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def test_graph_recall_on_random_points():
    rnd = np.random.default_rng(1)
    points = rnd.normal(size=(2048, 64))
    points *= rnd.uniform(0.5, 2, size=(2048, 1)) / np.linalg.norm(points, axis=1, keepdims=True)
    targets = rnd.normal(size=(60, 64))
    found = Graph.build(points).search(targets, 20, 160)
    best = np.argsort(-(targets @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, best, strict=True)]) > 0.9


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_POINTS", 256)  # three shards
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rnd = np.random.default_rng(2)
    vectors = rnd.normal(size=(600, 8)).astype(np.float32).astype(float)
    vectors[100:180] = vectors[100]  # a hot vector
    ids = np.arange(600) * 3
    rows = [(int(i), [float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)]
    bad = [(9001, None, "x"), (9020, [0.0] * 8, "x"), (9040, [float("nan")] * 8, "x"), (9060, [None] + [1.0] * 7, "x"), (9080, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (9100, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank string").repartition(5)
    got = {}
    for r in ann.nearest(df.where("vec_id % 20 = 0"), df, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids.tolist(), vectors, [i for i in ids.tolist() if i % 20 == 0], 20)
    assert sorted(got) == sorted(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
        assert all(abs(s - vectors[i // 3] @ vectors[q // 3]) < 1e-12 for _, i, s in found)
    assert hits / (20 * len(want)) > 0.97
    hot = [q for q in want if 300 <= q < 540]
    assert all([i for _, i, _ in got[q]] == [i for i, _ in want[q]] for q in hot)  # ties to smaller ids


def test_large_shards_touch_few_points():
    """The search of a shard is no scan: on unclustered points, it scores a small share of them."""
    rnd = np.random.default_rng(5)
    points = rnd.normal(size=(12_000, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = Graph.build(points)
    targets = points[:40] + rnd.normal(size=(40, 24)) * 0.05
    scored = []
    was = np.einsum
    try:
        np.einsum = lambda how, a, *rest: (scored.append(a.shape[0] * a.shape[1]) if how == "bkd,bd->bk" else None, was(how, a, *rest))[1]
        found = graph.search(targets, 20, 135)
    finally:
        np.einsum = was
    assert sum(scored) / len(targets) < 0.6 * len(points)  # repeats and places without a point count too
    best = np.argsort(-(targets @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, best, strict=True)]) > 0.95


def test_repeated_queries(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df.where("vec_id = 0"), df, k=2).collect())
    assert got == [(0, 1, 1, 0.5)] * 2 + [(0, 2, 3, 0.5)] * 2


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df.where(F.col("vec_id") % 20 == 0), df).collect())
    assert got == [(0, 1, 1, 0.5), (20, 1, 2, 1.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_recall_where_lengths_differ(spark):
    """The inner product of vectors as drawn: 12,000 in 64 dimensions, and some in 3."""
    rnd = np.random.default_rng(12)
    vectors = rnd.normal(size=(12_000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(20_000 + i, [float(i + 1), 0.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    asked = df.where("vec_id % 120 = 0 OR vec_id = 20020")
    found: dict = {}
    for r in ann.nearest(asked, df, k=20).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 101 and sorted(found.pop(20_020)) == [20_000 + i for i in range(9, 30) if i != 20]
    want = brute(range(12_000), vectors, found, 20)
    assert np.mean([len(set(found[q]) & {i for i, _ in want[q]}) / 20 for q in found]) >= 0.9
