import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece as library

from tarn.llm import sentencepiece
from tarn.llm.pieces import PieceCoder, Reader, combined, scan
from tarn.llm.tokens import flat_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rnd = random.Random(4)
    alphabet = ["the", "ing", "a", "é", "ß", "x", " ", " ", "\n", "梦", "🙂", "▁", "zz", "t", "on", "\x85", "\x00"]
    out = ["", " ", "  a   b    ", "a▁b", "x" * 500, "ab" * 300, " lead", "trail ", "\n\n\n", "Ünïcödé テスト", "the " * 50]
    out += ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 60))) for _ in range(400)]
    out += ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(1, 40))) for _ in range(400)]
    return out


@pytest.mark.parametrize("longest", [4, 48])
def test_against_the_library(longest, monkeypatch):
    monkeypatch.setattr("tarn.llm.pieces.LONGEST_WORD", longest)
    monkeypatch.setattr("tarn.llm.pieces.MEMORY", 256 if longest == 4 else 1 << 19)  # small: forgets again and again
    model, own, read, all_texts = library.SentencePieceProcessor(model_file=PATH), PieceCoder(PATH), Reader(PATH), texts()
    ids, sizes = own.encode_texts(*flat_bytes(pa.array(all_texts)))
    for t, got in zip(all_texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        want = model.encode(t)
        assert got.tolist() == want, repr(t)
        assert np.array(own.pieces.numbers(own.pieces.segment("▁" + t.replace(" ", "▁")) if t else [])).tolist() == want, repr(t)
        assert read.decode(np.array(want, "<u4")) == model.decode(want), t


def test_pieces_fit_as_merging_says():
    own, rnd = PieceCoder(PATH).pieces, random.Random(8)
    names = [p for p in own.ids if "▁" not in p[1:] and p != "▁▁"]
    common = names[:400]
    tried = [(rnd.choice(common), rnd.choice(common)) for _ in range(6000)] + [(rnd.choice(names), rnd.choice(names)) for _ in range(3000)] + [("", rnd.choice(names)) for _ in range(500)]
    fits = 0
    for one, two in tried:
        if not two.startswith("▁"):
            want = own.merged(one + two) == ([one, two] if one else [two])
            assert own.fit(one, two) == want, (one, two)
            fits += want
    assert fits > 500


def test_scan_is_all_prefix_products():
    rnd = np.random.default_rng(1)
    for n in range(1, 9):
        ms = [np.where(rnd.random((3, 3)) < 0.3, -np.inf, rnd.normal(size=(3, 3))) for _ in range(n)]
        one = ms[0]
        for got, nxt in zip(scan(ms), [*ms[1:], None], strict=True):
            assert np.allclose(got, one)
            one = combined(one, nxt) if nxt is not None else one


@pytest.mark.parametrize("giant", [40, 97, 1 << 16])
def test_chunks_against_the_library(spark, giant):
    model = library.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(giant)
    rows = [(i, t, 7) for i, t in enumerate(texts()[::3])]
    rows += [(5000 + i, "".join(rnd.choices("etaoinshrdlu ", k=400)).replace("  ", " t").strip(), 7) for i in range(40)]
    rows += [(5500 + i, "".join(rnd.choices(["the", "ing ", "é", " ", "  ", "     ", "▁", "\n", "t"], k=300)), 7) for i in range(30)]
    rows += [(5600, " " * 1000, 7), (5601, "   lead and" + " " * 333 + "trail  ", 7)]
    rows += [(6000, None, 7), (6001, "solidword" * 9000, 7), (6001, "solidword" * 9000, 7), (None, "no id here", 7)]
    df = spark.createDataFrame([(*r, 8, 9) for r in rows], "doc_id long, text string, row int, own int, part int").repartition(5)
    coded = sentencepiece.encode(df, PATH, giant=giant)
    assert coded.columns == ["doc_id", "text", "row", "own", "part", "n_tokens", "ids"]
    got = sentencepiece.decode(coded, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = model.encode(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == model.decode(want) and (r["row"], r["own"], r["part"]) == (7, 8, 9)


def test_empty(spark):
    assert sentencepiece.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert sentencepiece.decode(spark.createDataFrame([], "ids binary, decoded int"), PATH).count() == 0
    assert [tuple(r) for r in sentencepiece.decode(spark.createDataFrame([(None, 1)], "ids binary, x int"), PATH).collect()] == [(None, 1, "")]
