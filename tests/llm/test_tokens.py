import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarn.llm import token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  ", "a b", "a  b", "a   b", "a \n b", "a\n \nb", "x ", "x  ", " \n", "don't  won't", "a\u00a0 b", "é ß 你好 🙂", "<|endoftext|> a", "a <|endoftext|>", "1 2  33", "\t a", "a \t", "a\u3000 \u3000b", "w" * 70_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(library, spark, sf_dir):
    rnd = random.Random(5)
    texts = HARD + ["".join(rnd.choice(["a", " ", "\n", "  ", "'s", "9", "é", ".", "\u00a0", "B"]) for _ in range(30)) for _ in range(3000)]
    texts += [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, tokens.encode_all(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "most", 50)
    monkeypatch.setattr(tokens, "CHUNK", 200)
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("ab cé x.'s9"[:k]) * rnd.randrange(1, 5) + str(rnd.randrange(99)) for _ in range(20)).strip() for k in (2, 5, 9, 11) for _ in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_all(texts, PATH)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(library, spark, tmp_path):
    rows = [(i * 3 - 50, t, 1) for i, t in enumerate([*HARD, None] * 9)] + [(10_000, "same", 1)] * 3 + [(None, "no id", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(7)
    out = str(tmp_path / "t")
    token_files.BLOCK_IDS, was = 500, token_files.BLOCK_IDS
    try:
        token_files.write_tokens(df, out, PATH, 50257)
    finally:
        token_files.BLOCK_IDS = was
    got = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r["start"])
    want = sorted(((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, _ in rows), key=lambda x: (x[0] is not None, x))
    assert [(r["doc"], bytes(r["ids"])) for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0, *[len(x) // 4 for _, x in want]])[:-1].tolist()
    assert token_files.read_blocks(spark, out).agg({"width": "max"}).first()[0] == 16
    doc, ids = want[13]
    assert token_files.read_span(spark, out, doc, 1, 3).tolist() == np.frombuffer(ids, "<u4")[1:4].tolist()
    token_files.write_tokens(df.limit(0), out + "e", PATH, 50257)
    assert token_files.read_documents(spark, out + "e").count() == 0
    assert zlib.crc32(got[0]["ids"]) >= 0


def test_words_are_cut_where_the_library_cuts():
    """Letters, digits and marks apart: one word is learned for all its endings, and ids stay the library's."""
    rnd = random.Random(12)
    parts = ["don't", "it's,", "'s", "'S", "x'll.", "''s", "shoe", "shoe,", "shoe.", "a1b2", "12.5%", "(a)", "…,a", ".'s", "ß", "Éa", "é,", "×a", "a÷", "¿que", "ɏz", "ɐz", "ñ1", "日本,x", "áb", "­a", "à b", "#tag_x", "ÿ", "I'm'", "e.g.", "\x7fz", "Ħ-ē", "'re1"]
    texts = [" ".join(rnd.choices(parts, k=rnd.randint(1, 30))).replace(" x", "\nx") for _ in range(500)] + ["".join(rnd.choices(parts, k=5)) for _ in range(500)]
    enc = tokens.Encoder(PATH)
    raw, offsets = tokens.flat_bytes(pa.array(texts))
    ids, sizes = enc.encode(raw, offsets)
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    few = tokens.Encoder(PATH)
    few.encode(*tokens.flat_bytes(pa.array(["a shoe, shoe. shoe! shoe1 shoe2"])))
    assert [w for w in few.names.to_pylist() if b"shoe" in w] == [b" shoe"]
