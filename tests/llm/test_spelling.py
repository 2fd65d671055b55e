import random
import re
import zlib
from collections import Counter

import pytest

from tarn.llm import spelling


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts):
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def counted(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return total


def spelt(rnd, word, letters="abcéÿ"):
    i = rnd.randrange(len(word))
    return rnd.choice([word[:i] + word[i + 1 :], word[:i] + rnd.choice(letters) + word[i:], word[:i] + rnd.choice(letters) + word[i + 1 :]])


def test_words_and_variants_against_brute_force(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcéÀÿ", k=rnd.randrange(6, 12))) for _ in range(40)]
    rows = [(None, "Nullified nullified"), (1, None), (2, ""), (3, "123 Ābcdefgh × ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷")]
    for i in range(10, 150):
        words = []
        for _ in range(rnd.randrange(1, 60)):
            w = rnd.choice(base[: 1 + rnd.randrange(len(base))])
            words.append(spelt(rnd, w) if rnd.random() < 0.1 else w.upper() if rnd.random() < 0.2 else w)
        rows.append((i, rnd.choice([" ", ", ", "-1-"]).join(words)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(5)
    counts = spelling.word_counts(df, every=31)
    assert {r["word"]: r["n"] for r in counts.collect()} == counted(rows)
    assert sorted((tuple(r) for r in spelling.variants(counts, part=64).collect()), key=str) == sorted(brute(counted(rows)), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_runs_of_equal_letters_and_chains(spark, letters):
    """Words that leave the same strings in several ways, and forms of forms of forms."""
    rnd = random.Random(len(letters))
    counts = {"".join(rnd.choices(letters, k=rnd.randrange(7, 10))): rnd.choice([1, 2, 5, 30, 400, 5000]) for _ in range(500)}
    word = "q" * 7
    for k in range(10):
        counts[word] = 2 * 10**k
        word += "z"
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    got = sorted((tuple(r) for r in spelling.variants(df, part=100).collect()), key=str)
    assert got == sorted(brute(counts), key=str)
    assert {r[2] for r in got if r[0].startswith("qqqqqqq")} == {"q" * 7 + "z" * 9}


def test_keys_meet_where_strings_do():
    words = ["aab", "ab", "abb", "é漢x", "é漢", "b", ""]
    key, which, place, _ = spelling.deletion_keys(words)
    left = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(which, place, strict=True)]
    assert len(key) == sum(len(w) + 1 for w in words)
    for k, a in zip(key, left, strict=True):
        for j, b in zip(key, left, strict=True):
            assert (k == j) == (a == b)


def test_equal_keys_of_other_strings_are_told_apart(spark, monkeypatch):
    import pyarrow as pa

    table = pa.table({"id": [1, 2, 3], "word": ["abcdefg", "abcdefh", "zzzzzzz"], "n": [5, 90, 7], "place": pa.array([6, 6, 6], pa.int32()), "first": [True] * 3, "key": [4, 4, 4]})
    assert spelling._near(table).to_pylist() == [{"id": 1, "near": 1, "best_n": 90, "best": "abcdefh"}, {"id": 2, "near": 1, "best_n": 5, "best": "abcdefg"}]


def test_very_long_words_and_empty_tables(spark):
    long = "xy" * 30_000
    df = spark.createDataFrame([(long, 40), (long + "x", 3), (long[:-1] + "q", 4), ("short", 9)], "word string, n long")
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.variants(df).collect()}
    assert got == {long: (None, 2), long + "x": (long, 1), long[:-1] + "q": (long, 1), "short": (None, 0)}
    assert spelling.variants(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "Lettering lettering")], "`a.b` long, `t t` string")
    assert [tuple(r) for r in spelling.word_counts(odd, "a.b", "t t").collect()] == [("lettering", 2)]
