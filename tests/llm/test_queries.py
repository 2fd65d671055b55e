"""Every registered query of the subpackage on the smallest tables, against what its contract says."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tarn.llm import queries
from tests.llm.test_lm_scoring import brute as score_by_hand
from tests.llm.test_near_dedup import brute as near_by_hand
from tests.llm.test_near_dedup import roots
from tests.llm.test_simhash import brute as all_links
from tests.llm.test_simhash import fingerprint
from tests.test_oracles import TABLES
from tests.test_oracles import rows as plain_rows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def ids(docs):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in docs}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_all_are_tested():
    assert sorted(queries.QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate("packing exact_dedup url_filter html_extraction token_files quality_classifier sentencepiece nearest_neighbours minhash_near_dedup lm_scoring simhash_near_dedup conversation_repair spelling_variants".split(), 1))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    got, want = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain_rows(got.columns, [tuple(r) for r in got.collect()]) == plain_rows(names, want.fetchall())


def test_op1(spark, sf_dir, ids):
    got = queries.op1_packing(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    held, at = {}, {}
    for r in got.collect():
        own = [*ids[r["doc_id"]], 1]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        at.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans in held.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *[n for _, n in sorted(spans)]])[:-1].tolist() and sum(n for _, n in spans) <= 2048
    assert sorted(held) == list(range(len(held))) and sorted(at) == sorted(ids)
    for i, spans in at.items():
        assert [s for s, _ in sorted(spans)] == np.cumsum([0, *[n for _, n in sorted(spans)]])[:-1].tolist() and sum(n for _, n in spans) == len(ids[i]) + 1


def test_op4(spark, sf_dir):
    got = queries.op4_html_extraction(spark, sf_dir)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("<p>" in r["text"] or "  " in r["text"] or r["text"] != r["text"].strip() for r in rows) and sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)


def test_op5(spark, sf_dir, ids):
    got = queries.op5_token_files(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want, start = [], 0
    for i in sorted(ids):
        own = [*ids[i], 2]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_op6(spark, sf_dir, docs):
    rows = queries.op6_quality_classifier(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in docs] and all(r["kept"] == (r["p_quality"] >= 0.5) for r in rows)


def test_op7(spark, sf_dir, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    got = {r["doc_id"]: r for r in queries.op7_sentencepiece(spark, sf_dir).collect()}
    for i, t in docs:
        own = model.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(own), crc(own))
        assert got[i]["round_trip"] == (model.decode(own) == (t or ""))


def test_op8(spark, sf_dir):
    table = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    names, vectors = np.array([i for i, _ in table]), np.array([v for _, v in table], np.float64)
    found: dict = {}
    for r in queries.op8_nearest_neighbours(spark, sf_dir).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in names.tolist() if i % 20 == 0]
    assert sorted(found) == asked
    hits = 0
    for q in asked:
        own = vectors[names == q][0]
        score = dict(zip(names.tolist(), (vectors @ own).tolist(), strict=True))
        best = sorted((i for i in score if i != q), key=lambda i: (-score[i], i))[:20]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21)) and all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in got)
        hits += len({i for _, i, _ in got} & set(best))
    assert hits >= 0.9 * 20 * len(asked)


def test_op9(spark, sf_dir, docs):
    got = queries.op9_minhash_near_dedup(spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == near_by_hand(docs, 4)


def test_op10(spark, sf_dir, docs):
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in docs]
    got = queries.op10_lm_scoring(spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for g, w in zip(sorted(tuple(r) for r in got.collect()), sorted(score_by_hand(rows, 3, 2.0)), strict=True):
        assert g[:5] == w[:5] and g[5:7] == pytest.approx(w[5:], rel=1e-9)


def test_op11(spark, sf_dir, docs):
    got = queries.op11_simhash_near_dedup(spark, sf_dir)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    prints = {i: fingerprint(t) for i, t in docs}
    root = roots(sorted(set(prints.values())), all_links(sorted(set(prints.values()))))
    least: dict = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(i, f"{f:016x}", least[root[f]]) for i, f in sorted(prints.items())]
