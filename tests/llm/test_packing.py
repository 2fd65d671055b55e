import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarn.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_covers_demand_and_is_near_the_bound():
    rnd = random.Random(2)
    for unit, top in ((32, 5), (256, 3000)):
        demand = np.array([rnd.randrange(top) if rnd.random() < 0.7 and i < unit // 3 else 0 for i in range(unit)])
        used = packing.solve(demand, unit)
        assert (sum(p * t for p, t in used) == demand).all()
        sizes = np.arange(1, unit + 1)
        assert all(p @ sizes <= unit for p, _ in used)
        bound = np.ceil(demand @ sizes / unit)
        assert sum(t for _, t in used) <= bound + 1 + unit // 4


def test_knapsack_against_brute_force():
    prices = np.array([0.1, 0.25, 0.31, 0.5])
    best = max(a * 0.1 + b * 0.25 + c * 0.31 + d * 0.5 for a in range(8) for b in range(4) for c in range(3) for d in range(2) if a + 2 * b + 3 * c + 4 * d <= 7)
    value, pattern = packing._knapsack(prices, 7)
    assert abs(value - best) < 1e-12 and abs(pattern @ prices - best) < 1e-12


def test_every_id_lies_in_exactly_one_place(spark):
    rnd = random.Random(7)
    rows = [(i if i % 50 else None, rnd.choice([None, "", "a", "word " * rnd.randrange(1, 900), "x" * rnd.randrange(4000)]), 1) for i in range(800)]
    rows += [(9000, "same text", 1)] * 2 + [(9001, "w " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(6)
    packed = packing.pack(packing.cut(df, PATH)).cache()
    got = packed.collect()
    t = Tokenizer.from_file(PATH)
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in rows)
    assert sum(r["length"] for r in got) == want and all(len(r["ids"]) == 4 * r["length"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist() and sum(n for _, n in spans) <= 2048
    whole = [r for r in got if r["doc_id"] == 9001]
    ids = b"".join(bytes(r["ids"]) for r in sorted(whole, key=lambda r: r["start"]))
    assert np.frombuffer(ids, "<u4").tolist() == [*t.encode("w " * 40_000, add_special_tokens=False).ids, 1]
    assert packing.sequences(packed).agg({"n_ids": "sum"}).first()[0] == want
    assert packing.pack(packing.cut(df.limit(0), PATH)).count() == 0


def test_little_padding(spark):
    lengths = spark.range(20_000).selectExpr("id AS doc_id", "1 + cast(pow(2, 11 * rand(3)) as long) % 2048 AS length")
    packed = packing.pack(lengths)
    n = packed.agg({"sequence_id": "max"}).first()[0] + 1
    total = packed.agg({"length": "sum"}).first()[0]
    assert total / (n * 2048) > 0.97


def test_own_columns_keep_their_names(spark):
    names = ["class", "base", "low", "of", "task", "row", "size", "rank", "_class", "_row", "piece", "each", "n", "before", "a.b"]
    df = spark.createDataFrame([(5, *[f"{n}{i}" for n in names]) for i in range(30)], ["length", *names])
    packed = packing.pack(df.withColumn("offset", df["length"]))
    assert packed.columns == ["length", *names, "sequence_id", "offset"]
    got = packed.collect()
    assert sorted(r["class"] for r in got) == sorted(f"class{i}" for i in range(30)) and all(r["a.b"][3:] == r["_row"][4:] for r in got)
