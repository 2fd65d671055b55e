import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.operators import search as Q
from tarn.operators.textindex import TextIndex

WORDS = ["redis", "cache", "Über", "the", "then", "other", "a", "of", "x\ny", "漢字検索", "aaaa", "re-dis", "lock."]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def texts(rnd, ids):
    return [(i, rnd.choice([" ", "  "]).join(rnd.choices(WORDS, k=rnd.randrange(30)))) for i in ids]


QUERIES = [(1, "redis cache"), (2, "THE  other"), (3, "aaa"), (4, "字検索"), (5, "the of"), (6, "nothing here"), (7, "re* ca*"), (8, "a of x"), (9, None), (10, "y redis cache")]


@pytest.mark.parametrize("few", [0, 500])
def test_equals_a_scan_through_all_changes(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("tarn.operators.textindex.FEW_TOKENS", few)
    rnd = random.Random(few)
    index, live = TextIndex(spark, str(tmp_path / "index")), {}
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    frame = lambda pairs: spark.createDataFrame(pairs, "id long, content string")
    assert index.search(asked, 5).count() == 0

    def same():
        docs = frame([*live.items()])
        for n in (None, 3):
            got, want = index.search(asked, n), Q.bm25_search(docs, asked, n)
            if n:
                got, want = (Q.top_per_query(x, n, "rank") for x in (got, want))
            assert rows(got) == rows(want)

    own = texts(rnd, range(40))
    index.add(frame([*own, (None, "no id"), (99, None)]))
    live |= dict(own)
    same()
    index.delete(frame([(3, ""), (7, ""), (1000, "")]))
    live = {i: t for i, t in live.items() if i not in (3, 7)}
    own = texts(rnd, [5, 6, 7, 50, 51])
    index.refresh(frame(own))
    live |= dict(own)
    index.refresh(frame([(5, "redis cache once more")]))
    live[5] = "redis cache once more"
    same()
    index.merge()
    same()
    assert index._state()[1:] == ([5], [])
    index.delete(frame([(i, "") for i in live]))
    assert index.search(asked, 5).count() == 0 and index.totals()[0] == 0


def test_bound_leaves_no_better_row_out(spark, monkeypatch):
    """Many queries and ties: the best of the pruned result are the best of the whole one."""
    rnd = random.Random(8)
    names = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ("n", "r", "st", "lm")]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(names, weights=[1 / (k + 1) for k in range(len(names))], k=rnd.randrange(1, 60)))) for i in range(400)], "id long, content string")
    asked = spark.createDataFrame([(q, " ".join(rnd.sample(names, rnd.randrange(1, 9)))) for q in range(60)], "query_id long, query string")
    whole = Q.top_per_query(Q.bm25_search(docs, asked), 10, "rank")
    pruned = Q.bm25_search(docs, asked, 10)
    assert rows(Q.top_per_query(pruned, 10, "rank")) == rows(whole)
    assert pruned.count() < 0.7 * Q.bm25_search(docs, asked).count()
    monkeypatch.setattr(Q, "BLOCK_PHRASES", 7)
    monkeypatch.setattr(Q, "BLOCK_TERMS", 40)
    assert rows(Q.top_per_query(Q.bm25_search(docs, asked, 10), 10, "rank")) == rows(whole)


@pytest.mark.parametrize("entry", [0, 1 << 40])
def test_postings_and_texts_give_the_same(spark, tmp_path, monkeypatch, entry):
    """What costs more by its postings than by all texts is counted in the texts, where they lie; either way the results are a scan's."""
    monkeypatch.setattr("tarn.operators.textindex.ENTRY_BYTES", entry)
    docs = spark.createDataFrame(texts(random.Random(3), range(60)), "id long, content string")
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = TextIndex(spark, str(tmp_path / "index"))
    index.add(docs)
    index.delete(docs.where("id % 7 = 0"))
    assert rows(index.search(asked)) == rows(Q.bm25_search(docs.where("id % 7 != 0"), asked))
    plan = index.hits(Q.asked_phrases(asked))._jdf.queryExecution().executedPlan().toString()
    assert ("collect_list" in plan) == (entry == 0)  # postings are put together by id, texts are counted as they lie


def test_phrases_are_found_as_a_scan_finds_them():
    """Words, what stands over white space of any kind, what overlaps, and words that were met before."""
    rnd = random.Random(6)
    alphabet = ["a", "b", "aa", "ab", "é", "据", "😀", " ", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\u00a0", "-"]
    made = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    texts = ["", " ", "a", "aaaa aaaa", *(made(rnd.randrange(60)) for _ in range(400)), "a b aa ab é b a aa " * 40]
    phrases = [*{made(rnd.randrange(1, 7)) for _ in range(300)}, " ", "\n", "a b aa ab é b a aa a b aa", "a b aa ab é b a ab"]
    own = Q._Sought(phrases)
    for part in (texts, texts[::-1], [], [""], texts[100:300]):
        row, phrase, times = own.counts(pa.array(part, pa.string()))
        assert (np.diff(row) >= 0).all()
        got = sorted(zip(row.tolist(), phrase.tolist(), times.tolist(), strict=True))
        assert got == [(i, k, t.count(p)) for i, t in enumerate(part) for k, p in enumerate(phrases) if p in t]


def test_only_rows_below_a_limit(spark, tmp_path):
    """The best of a query's own number among the rows below its limit, as all rows filtered; few others leave the tasks."""
    rnd = random.Random(9)
    words = [f"w{i}x" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=30))) for i in range(3000)], "id long, content string")
    index = TextIndex(spark, str(tmp_path / "limits"))
    index.add(docs)
    queries = [(q, " ".join(rnd.sample(words, 4)) if q else None) for q in range(12)]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    until, n = {q: [0, 30, 1500, 3000][q % 4] for q, _ in queries}, {q: 1 + q % 3 for q, _ in queries}
    limits = spark.createDataFrame([(q, until[q], until[q] / 3000, n[q]) for q, _ in queries], "query_id long, until long, share double, n int")
    every = [tuple(r) for r in index.search(asked).collect()]
    got = [tuple(r) for r in index.search(asked, limits=limits, stamps=docs.where("id % 7 != 3").select("id", F.col("id").alias("stamp"))).collect()]
    best = lambda rows: {q: sorted((-s, i) for k, i, s in rows if k == q)[: n[q]] for q, _ in queries}
    assert best(got) == best([r for r in every if r[1] < until[r[0]] and r[1] % 7 != 3])
    assert all(r[1] < until[r[0]] for r in got) and 0 < len(got) < len(every) / 5
