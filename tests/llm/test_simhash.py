import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import simhash
from tests.llm.test_near_dedup import roots


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def fingerprint(text, size=3):
    w = words(text)
    if not w:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in found) > len(found))


def brute(codes):
    """Links of all pairs that differ in two bits at most."""
    return [(a, b) for i, a in enumerate(codes) for b in codes[:i] if (a ^ b).bit_count() <= 2]


def test_hashes_against_the_library(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aé漢 \n") for _ in range(n)) for n in [*range(0, 70), 95, 96, 97, 200, 1000]]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    got = simhash.xxh64(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(r, 42) for r in raw]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.xxhash64("t")).collect()] == got.view(np.int64).tolist()


def test_fingerprints_of_hard_texts(spark):
    rnd = random.Random(3)
    some = ["a", "bb", "Ünï", "x" * 50, "hello", "WORLD", "漢字", "q\x85r"]
    texts = [None, "", " \n\t", "One", "one two", "one Two three", "  lead  trail ", "w " * 3000, "long" * 30_000]
    texts += ["".join(rnd.choice(some) + rnd.choice([" ", "\n", "  ", "\t \r", "\x0b"]) for _ in range(rnd.randrange(1, 900))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, code string").repartition(3)
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash_groups(df).collect()}
    assert got == {i: f"{fingerprint(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_of_codes_against_all_pairs(spark, crowd):
    rnd = random.Random(crowd)
    codes = {0, 1, 3, 7, 2**64 - 1, 2**63}
    for _ in range(12):
        base = rnd.getrandbits(64)
        codes |= {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for _ in range(12)}
    low = rnd.getrandbits(32)
    codes |= {(rnd.getrandbits(32) & 0xFF000FFF) << 32 | low for _ in range(150)}  # a crowded half
    codes = sorted(codes)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    links = [tuple(r) for r in simhash.near_codes(df, crowd).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    assert roots(sorted(map(signed, codes)), links) == roots(sorted(map(signed, codes)), [(signed(a), signed(b)) for a, b in brute(codes)])


def test_crowded_keys_make_rows_that_grow_with_the_codes(spark):
    """All ways to set twelve bits of one half: 4096 codes of one key, 319,488 pairs within two bits."""
    codes = spark.range(4096).select(F.col("id").alias("code"))
    links = simhash.near_codes(codes)
    assert links.count() < 66 * 4096
    assert simhash.connected_components(links).where("component = 0").count() == 4096


def test_groups_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, i = [(None, "alone and without id"), (None, "alone and without id"), (4, None), (3, ""), (9, "tiny"), (9, "tiny")], 20
    for _ in range(40):
        base = rnd.choices(vocabulary, k=rnd.randrange(3, 400))
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((i, rnd.choice([" ", "  "]).join(copy).upper()))
            base = copy if rnd.random() < 0.5 else base
            i += 1
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int").repartition(4)
    own = [fingerprint(t) for _, t in rows]
    root = roots(sorted(set(own)), brute(sorted(set(own))))
    least = {}
    for (i, _), f in zip(rows, own, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f]), i == least.get(root[f])) for (i, _), f in zip(rows, own, strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.simhash_groups(df).collect()), key=str) == want


def test_empty_table_and_odd_names(spark):
    df = spark.createDataFrame([(1, "a b c")], "`d.id` long, `the text` string")
    assert simhash.simhash_groups(df, "d.id", "the text").columns == ["d.id", "fingerprint", "component_id", "kept"]
    assert simhash.simhash_groups(df, "d.id", "the text").count() == 1
    assert simhash.simhash_groups(df.limit(0), "d.id", "the text").count() == 0
