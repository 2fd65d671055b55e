import random

import numpy as np
import pytest

from tarn.llm import near_dedup
from tarn.llm.components import connected_components
from tests.llm.test_lm_scoring import tokens


def shingle_set(text, size):
    w = tokens(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, size):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.append((i, j))
    root = roots([i for i, _ in sets], links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets)


def corpus(rnd, families=12):
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three four"), (6, "x\x85y one")]
    i = 10
    shared = rnd.choices(words, k=60)
    for _ in range(families):
        base = rnd.choices(words, k=rnd.randrange(20, 200)) + shared * rnd.randrange(2)
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(1, len(base) // 18))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((i, " ".join(copy)))
            base = copy if rnd.random() < 0.5 else base  # chains
            i += 1
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(spark, size):
    rnd = random.Random(size)
    rows = corpus(rnd)
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string").repartition(4)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df, shingle_words=size).collect())
    assert got == brute(rows, size)
    kept = near_dedup.drop_near_duplicates(df, shingle_words=size)
    assert kept.columns == ["doc_id", "text", "node"] and sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in brute(rows, size) if r[3]]


def test_repeats_nulls_long_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone in here now"), (5, long), (6, long + " tail"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df, shingle_words=4).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 1, None, True), (5, 59997, 5, True), (6, 59998, 5, False), (7, 0, 7, True)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sequential_comparison_keeps_true_pairs():
    rnd = np.random.default_rng(4)
    fewest = near_dedup.fewest_matches(0.8, 1e-6)
    equal = rnd.random((20_000, 160)) < 0.8 + 0.2 / 256
    steps = equal.reshape(20_000, -1, near_dedup.BATCH).sum(axis=2).cumsum(axis=1)
    assert (steps < fewest).any(axis=1).mean() < 1e-3
    assert fewest[-1] > 80


def test_signature_estimates_similarity():
    a, b = (near_dedup.shingles(" ".join(f"w{i}" for i in range(x, x + 1000)), 1) for x in (0, 250))
    share = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(share - 0.6) < 0.12


def test_components_against_union_find(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {n: r for n, r in roots(sorted({x for p in links for x in p}), links).items() if n in nodes}
    assert connected_components(df.limit(0)).count() == 0
