import math
import random
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tarn.llm import golomb, lm_scoring

SPACE = " \t\n\r\x0b\f"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def brute(rows, order, strength):
    grams = [Counter() for _ in range(order + 1)]
    for _, text, train in rows:
        if train:
            seq = [" begin", *tokens(text), " end"]
            for n in range(1, order + 1):
                grams[n].update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
    total = sum(c for g, c in grams[1].items() if g != (" begin",))
    vocabulary = len([g for g in grams[1] if g != (" begin",)])

    def p(history, w):
        lower = (grams[1][(w,)] + 1) / (total + vocabulary + 1)
        for n in range(2, order + 1):
            if len(history) < n - 1:
                return lower
            h = history[-(n - 1) :]
            lower = (grams[n][(*h, w)] + strength * lower) / (grams[n - 1][h] + strength)
        return lower

    out = []
    for doc, text, train in rows:
        seq = [*tokens(text), " end"]
        base = sum(math.log10((grams[1][(w,)] + 1) / (total + vocabulary + 1)) for w in seq)
        score, history = 0.0, (" begin",)
        for w in seq:
            score += math.log10(p(history, w))
            history = (*history, w)
        out.append((doc, not train, len(seq), sum(grams[1][(w,)] > 0 for w in seq), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order, monkeypatch):
    rnd = random.Random(order)
    vocabulary = ["a", "B", "b", "É", "é", "</s>", "<s>", "x\x85y", "x y", "\x1c"]
    rows = [(i, None if i % 17 == 0 else "".join(rnd.choice(vocabulary) + rnd.choice(SPACE) * rnd.randrange(1, 3) for _ in range(rnd.randrange(40))), i % 5 != 2) for i in range(120)]
    rows += [(None, "a b", True), (7, "a b", True), (7, "a b", False), (900, "a b " * 30_000, True)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, t boolean, score string").repartition(3)
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 500)
    monkeypatch.setattr(lm_scoring, "OWNER_NGRAMS", 50_000 if order < 3 else 4_000)  # very many owners, most of them without n-grams
    got = [tuple(r) for r in lm_scoring.score_documents(df, F.col("t"), order=order, strength=4.0).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for g, w in zip(sorted(got, key=key), sorted(brute(rows, order, 4.0), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    """From every state that two words lead to, over all known words, an unknown one and the end."""
    rnd = random.Random(3)
    known, unknown = ["a", "b", "c", "d"], "unknown"
    learned = [" ".join(rnd.choices(known, k=rnd.randrange(9))) for _ in range(30)]
    contexts = ["", *known, unknown, *(f"{x} {y}" for x in [*known, unknown] for y in [*known, unknown])]
    probes = [f"{c} {w}".strip() for c in contexts for w in [*known, unknown]] + contexts
    texts = [t.encode() for t in learned + probes]
    row = SimpleNamespace(
        sizes=np.array([len(t) for t in texts], "<i8").tobytes(), train=np.array([1] * len(learned) + [0] * len(probes), np.uint8).tobytes(), texts=zstandard.compress(b"".join(texts))
    )
    grams = lm_scoring.Grams(row, 3, 60)
    distinct, counts = grams.distinct()
    values, slot = np.unique(grams.all_keys(), return_inverse=True)
    assert (values == distinct).all()
    words = (distinct & lm_scoring.WORD) > 0
    automaton = lm_scoring.Automaton(grams, *grams.by_length(slot, counts), int(counts[words].sum()), int((words & (counts > 0)).sum()), 2.0)
    at = {p: (int(grams.starts[len(learned) + i]), int(grams.sizes[len(learned) + i])) for i, p in enumerate(probes)}
    for c in contexts:
        begin, size = at[c]
        before = automaton.traverse(begin, begin + size - 1)
        after = [automaton.traverse(begin, begin + size)]  # the end
        for w in [*known, unknown]:
            begin, size = at[f"{c} {w}".strip()]
            after.append(automaton.traverse(begin, begin + size - 1))
        assert sum(10 ** (x - before) for x in after) == pytest.approx(1, abs=1e-9), c


def test_cost_does_not_grow_with_owners():
    """A batch's messages to thousands of owners, and an owner's from as many batches, cost about what a few of the same content do."""
    rnd = np.random.default_rng(5)
    text = " ".join(map(str, rnd.integers(0, 1 << 30, 60_000))).encode()
    row = SimpleNamespace(batch=1, sizes=np.array([len(text)], "<i8").tobytes(), train=b"\1", texts=zstandard.compress(text))
    frame = SimpleNamespace(itertuples=lambda: [row])

    def cost(owners):
        began = time.process_time()
        (sent,) = lm_scoring._messages([frame], 3, 55, owners)
        sent = sent.assign(owner=0)  # as if they were of one owner: what they hold does not count here
        answers = lm_scoring._totals(sent, 55, owners)
        assert answers["n"].sum() == sent["n"].sum() > 150_000
        return time.process_time() - began

    cost(10)
    assert cost(4000) < 0.3 + 4 * min(cost(10) for _ in range(3))


def test_owners_answer_every_batch():
    """Totals of words and longer n-grams over batches, in the order in which a batch has its keys; most owners have few keys or none."""
    rnd = random.Random(8)
    texts = [b" ".join(rnd.choice([b"a", b"b", b"c d", b"%d" % rnd.randrange(300)]) for _ in range(n)) for n in (0, 1, 40, 900)]
    texts[3] += b" a a" * 400  # counts of more than a byte
    rows = [SimpleNamespace(batch=i, sizes=np.array([len(t)], "<i8").tobytes(), train=np.array([i != 2], np.uint8).tobytes(), texts=zstandard.compress(t)) for i, t in enumerate(texts)]
    for owners in (1, 7, 5000):
        sent = pd.concat([m for r in rows for m in lm_scoring._messages([SimpleNamespace(itertuples=lambda r=r: [r])], 3, 40, owners)])
        answers = pd.concat([lm_scoring._totals(g.reset_index(drop=True), 40, owners) for _, g in sent.groupby("owner")])
        expected = Counter()
        for r in rows:
            expected.update(dict(zip(*(x.tolist() for x in lm_scoring.Grams(r, 3, 40).distinct()), strict=True)))
        for r in rows:
            distinct, own = lm_scoring.Grams(r, 3, 40).distinct()[0], answers[answers["batch"] == r.batch].sort_values("owner")
            totals = np.zeros(len(distinct), np.int64)
            totals[lm_scoring._in_turn(lm_scoring._by_kind(distinct, owners)[1])] = lm_scoring._read_numbers(own["totals"].tolist(), own["n"].tolist())
            assert totals.tolist() == [expected[k] for k in distinct.tolist()]
        assert answers["vocabulary"].sum() == sum(n > 0 and k & 2 > 0 for k, n in expected.items())


@pytest.mark.parametrize("bits", [3, 20, 62, 64])
def test_many_sets_at_once(bits):
    rnd = np.random.default_rng(bits)
    sets = [np.unique(rnd.integers(0, 1 << bits, n, np.uint64, endpoint=False) if bits < 64 else rnd.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True)) for n in (0, 1, 3, 0, 300, 2, 0)]
    k, runs = golomb.encode_runs(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), bits)
    assert len(runs) == len(sets) and runs[0] == (0, b"")
    sizes, heads = np.array([len(x) for x in sets]), np.array([h for h, _ in runs])
    # runs of other parameters among them, as messages of several batches have
    alone, codes = golomb.encode_runs(sets[1], np.array([0, len(sets[1])]), bits)
    back = golomb.decode_runs(np.append(sizes, len(sets[1])), np.array([k] * len(sets) + [alone]), np.append(heads, codes[0][0]), [c for _, c in runs] + [codes[0][1]])
    assert (back == np.concatenate([*sets, sets[1]])).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score_documents(df, F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    (r,) = lm_scoring.score_documents(df, F.lit(False)).collect()
    assert (r["train_tokens"], r["n_known"], r["score"]) == (0, 0, 0.0)
