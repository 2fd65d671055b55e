import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import quality


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = labels.where(F.xxhash64("doc_id") % 2 == 0)
    got = quality.classify(docs, seen).join(labels.where(F.xxhash64("doc_id") % 2 != 0), "doc_id").toPandas()
    assert len(got) > 20 and (got["kept"] == (got["quality"] == 1)).mean() > 0.93
    assert got["p_quality"].between(0, 1).all()


def site_rows(rnd):
    good = lambda: " ".join(rnd.choices(["calm", "river", "walks", "over", "stone"], k=30)) + "."
    bad = lambda: "!!! ".join(rnd.choices(["BUY", "NOW", "WIN"], k=30))
    rows, labels = [], []
    for i in range(600):
        host = "bad.example" if i % 3 == 0 else "good.example"
        fine = rnd.random() < (0.15 if host == "bad.example" else 0.9)
        rows.append((i, good() if fine else bad(), "en", host, "z"))
        if i % 2:
            labels.append((i, int(fine), 0))
    return rows, labels


def test_sites_shrink(spark):
    rnd = random.Random(3)
    rows, labels = site_rows(rnd)
    rows += [(1000, None, "en", "new.example", "z"), (1001, "", None, None, "z"), (1002, "calm river. " * 20_000, "en", "bad.example", "z"), (1003, "calm", "de", "bad.example", "z"), (1003, "calm", "de", "bad.example", "z"), (None, "calm river", "en", "good.example", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, evidence string")
    docs = docs.withColumns({c: F.lit("z") for c in ("kept", "own", "host", "path", "n", "site_n", "p_site", "_evidence", "_keep", "_host")}).repartition(4)
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert len(got) == len(rows)
    site = {r.doc_id: r.p_site for r in got.itertuples()}
    assert site[0] < 0.4 < 0.7 < site[1]
    assert abs(site[1000] - (got["p_document"].sum() / len(got))) < 0.1  # an unseen host takes the global rate
    assert site[1003] < site[1000]  # a sparse path leans on its host
    kept = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and kept.count() == got["kept"].sum()
    assert all(set(r[4:]) == {"z"} for r in kept.collect())  # a table's own columns come back as they were


def test_posteriors_against_brute_force(spark):
    rnd = random.Random(8)
    rows, labels = site_rows(rnd)
    rows += [(1000 + i, rnd.choice([None, "calm river.", "BUY!!! NOW"]), rnd.choice(["en", "de", None]), rnd.choice(["good.example", "few.example", None]), "z") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, x string").repartition(3)
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, label_rows)
    evidence = model.evidence([r[1] for r in rows])
    p = 1 / (1 + np.exp(-(evidence + model.base)))
    by_path, by_host = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        by_path[(r[3], r[2])].append(x)
        by_host[r[3]].append(x)
    n, rate = len(p), (p.sum() + 1) / (len(p) + 2)
    noise = max(1e-9, (p * p).sum() / n - rate * rate)

    def strength(groups, spread):
        between = max(spread - noise * groups / n, 1e-6)
        return min(max(rate * (1 - rate) / between - 1, 1.0), 1e6)

    k0 = strength(len(by_host), sum(len(x) * (np.mean(x) - rate) ** 2 for x in by_host.values()) / n)
    k1 = strength(len(by_path) - len(by_host), sum(len(x) * (np.mean(x) - np.mean(by_host[h])) ** 2 for (h, _), x in by_path.items()) / n)
    want = {}
    for r, e, own in zip(rows, evidence, p, strict=True):
        host, path = by_host[r[3]], by_path[(r[3], r[2])]
        host_rate = (sum(host) - own + k0 * rate) / (len(host) - 1 + k0)
        site = (sum(path) - own + k1 * host_rate) / (len(path) - 1 + k1)
        want[r[0]] = (own, site, 1 / (1 + math.exp(-(e + math.log(site / (1 - site))))))
    got = quality.classify(docs, label_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["p_document"], r["p_site"], r["p_quality"]) == pytest.approx(want[r["doc_id"]], rel=1e-9) and r["kept"] == (r["p_quality"] >= 0.5)


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs.limit(0), labels).count() == 0
    (r,) = quality.classify(docs, labels).collect()
    assert abs(r["p_document"] - 0.5) < 1e-9
