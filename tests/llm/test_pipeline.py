import numpy as np

import corpus_pipeline
from tarn.llm import exact_dedup, near_dedup, quality
from tests.llm.test_near_dedup import brute


def test_stages_on_the_smallest_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    one = corpus_pipeline.quality_stage(spark, docs, sf_dir).cache()
    kept = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").count()
    assert one.columns == columns and one.count() == kept < docs.count()
    two = corpus_pipeline.exact_dedup_stage(spark, one, sf_dir).cache()
    lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    largest = {}
    for r in one.collect():
        t = (r["text"] or "").translate(lower)
        largest[t] = max(largest.get(t, -1), r["doc_id"])
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(largest.values())
    three = corpus_pipeline.near_dedup_stage(spark, two, sf_dir).cache()
    want = [r[0] for r in brute([(r["doc_id"], r["text"]) for r in two.collect()], 5) if r[3]]
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == want
    packed = corpus_pipeline.packing_stage(spark, three, sf_dir).toPandas()
    assert set(packed["doc_id"]) == set(want)
    pieces = packed.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert (pieces["length"].sum() == pieces["doc_tokens"].first()).all()
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == np.r_[0, own["length"].cumsum()[:-1]].tolist() and own["length"].sum() <= 2048


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "packing"]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_hard_rows(spark, tmp_path):
    """Nulls, repeated rows, ties, long and blank texts, clashing columns; then an empty table."""
    prose = "the calm river walks over the stone and the long road goes on to the sea where a boat waits for the wind of the morning "
    texts = [None, "", " \n", prose + "one", prose.upper() + "ONE", prose + "one", prose * 400, prose + "two", "BUY!!! NOW!!! WIN!!! " * 9]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, texts[7], None, None), (None, None, None, None)]
    extra = ["kept", "own", "host", "path", "row", "class", "key", "norm", "doc", "ids", "length", "sequence_id", "n"]
    df = spark.createDataFrame([(*r, *["z"] * len(extra)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in extra)).repartition(3)
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, 1, 0), (7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    for docs in (df, df.limit(0)):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder).cache()
            assert now.columns == docs.columns and all(set(r[4:]) == {"z"} for r in now.collect())
        packed = corpus_pipeline.packing_stage(spark, now, folder)
        assert packed.count() >= now.count() and {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in now.collect()}
    one = corpus_pipeline.exact_dedup_stage(spark, df, folder)
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 2, 5, 6, 7, 8]  # rows without an id give way to those with one
