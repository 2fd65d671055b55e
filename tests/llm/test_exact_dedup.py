import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tarn.llm import exact_dedup, golomb


def brute(rows):
    groups = defaultdict(list)
    lower = {i: chr(i + 32) for i in range(65, 91)}
    for i, t in rows:
        groups[(t or "").translate(lower)].append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 7, 16, 17, 40, 62])
def test_packing_round_trip(width):
    values = np.array([random.Random(width).getrandbits(width) for _ in range(1001)], np.uint64)
    code = golomb.pack(values, width)
    assert len(code) == (1001 * width + 7) // 8
    assert (golomb.unpack(code, width, 1001) == values).all()
    assert (golomb.unpack(code, width, 37, 501) == values[501:538]).all()


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    values = np.sort(np.array(random.Random(n).sample(range(1 << 40), n), np.uint64))
    k, code = golomb.encode(values, 40)
    assert (golomb.decode(n, k, code) == values).all()
    if n == 1000:
        assert len(code) * 8 < n * (40 - 10 + 2.6) + 128


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", None, "Ä", "ä", "A b", "a B", "x" * 200_000, "X" * 200_000, "\n", "İ"]
    rows = [(i, rnd.choice(texts) if i % 3 else f"only {i}") for i in range(400)]
    rows += [(5000, "hot")] * 3 + [(6000 + i, "HOT") for i in range(200)] + [(None, "lone"), (None, "hot")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, keep_id string").repartition(5)
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(df, slack=2).collect()), key=str)
    want = brute(rows)
    assert [x for x in got if x[0] is not None] == [x for x in want if x[0] is not None]
    assert len(got) == len(want)


def test_empty_and_filter(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a", 1), (2, "A", 2), (3, "b", 3)], "doc_id long, text string, sha int")
    assert sorted(tuple(r) for r in exact_dedup.drop_exact_duplicates(df).collect()) == [(2, "A", 2), (3, "b", 3)]


def test_owners_grow_with_the_rows():
    for rows in (10, 10**6, 10**8, 10**10):
        bits = int(min(56, max(8, np.ceil(np.log2(max(2, rows)))) + 12))
        n = exact_dedup.exchange_owners(rows, 200, bits)
        assert n >= 200 and rows / n <= exact_dedup.OWNER_ROWS and bits + np.log2(n) <= 63
