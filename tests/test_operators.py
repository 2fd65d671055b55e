"""Operators on small tables, against literals and plain Python."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.operators import context as C
from tarn.operators import cycle as Y
from tarn.operators import dedup as D
from tarn.operators import filters as FL
from tarn.operators import graph as G
from tarn.operators import lifecycle as L
from tarn.operators import loops as P
from tarn.operators import mailbox as M
from tarn.operators import search as Q


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# search


def test_query_phrases(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(["Big  red fox", "inte* fo*", "数据库 迁移到 pg 双字", "ab", "", None])], "i int, q string")
    got = [r["p"] for r in df.orderBy("i").select(Q.query_phrases(F.col("q")).alias("p")).collect()]
    assert got[0] == ["big red fox", "big", "red", "fox"] and got[1] == ["inte"]
    assert got[2] == ["数据库", "迁移到"] and not got[3] and not got[4] and not got[5]


def test_phrase_search_counts_substrings(spark):
    docs = spark.createDataFrame([(1, "the REDIS cache; redis"), (2, "predisposed"), (3, "nothing"), (4, None), (5, "aaaa aaa")], "id long, content string")
    assert rows(Q.phrase_hits(docs, ["redis", "aaa"])) == [(1, "redis", 2, 20), (2, "redis", 1, 9), (5, "aaa", 2, 6)]
    queries = spark.createDataFrame([(7, "redis"), (8, "zzz")], "query_id long, query string")
    got = rows(Q.bm25_search(docs, queries))
    assert [r[:2] for r in got] == [(7, 1), (7, 2)] and all(r[2] > 0 for r in got)
    assert Q.bm25_search(docs, queries.limit(0)).count() == 0


def test_vector_search_against_numpy(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(300, 5)).round(3)
    v[7] = 0
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0]), (902, [None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "id long, embedding array<double>").repartition(4)
    asked = df.where("id IN (3, 7, 900, 901)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vec"))
    got = rows(Q.top_per_query(Q.vector_search(df, asked, 6), 6, "rank").select("query_id", "rank", "id"))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    score = unit @ unit.T
    want = [(q, r + 1, int(i)) for q in (3, 7) for r, i in enumerate(sorted(range(300), key=lambda i: (-score[q, i], i))[:6])] + [(901, 1, 901)]
    assert got == sorted(want, key=str)


def test_fusion_and_routing(spark):
    ft = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, ft_rank int")
    sem = spark.createDataFrame([(1, 11, 1)], "query_id long, id long, sem_rank int")
    ent = spark.createDataFrame([(1, 10, 1), (1, 12, 2)], "query_id long, id long, entity_rank int")
    hops = spark.createDataFrame([(1, 13, 1)], "query_id long, id long, hop_rank int")
    got = {r["id"]: (r["ft_rank"], r["sem_rank"], r["rrf"]) for r in Q.fused(ft, sem, ent, hops).collect()}
    assert got == {10: (1, None, 0.5 / 61), 11: (2, 1, 0.5 / 62 + 0.5 / 61), 12: (None, 2, 0.5 / 62), 13: (None, 100, 0.5 / 160)}
    names = spark.createDataFrame([(1, 0, "Bob"), (1, 1, "ann"), (1, 7, "late")], "query_id long, place int, name string")
    entities = spark.createDataFrame([(5, "Robert"), (6, "ann"), (7, "late")], "id long, name string")
    aliases = spark.createDataFrame([(5, "Bob")], "entity_id long, alias string")
    links = spark.createDataFrame([(20, 5), (21, 5), (20, 6), (22, 6), (23, 7)], "memory_id long, entity_id long")
    memories = spark.createDataFrame([(20, 1), (21, 2), (22, 3), (23, 4)], "id long, updated int")
    assert rows(Q.entity_routed(names, links, entities, aliases, memories, 2)) == [(1, 20, 2), (1, 21, 1), (1, 22, 3)]


def test_expansion_stops_when_full(spark):
    found = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (2, 12)], "query_id long, id long")
    links = spark.createDataFrame([(10, 1), (20, 2), (21, 3), (22, 1)], "memory_id long, entity_id long")
    relations = spark.createDataFrame([(2, 1), (2, 3)], "source_id long, target_id long")
    allowed = spark.createDataFrame([(20, 5), (21, 6), (22, 4)], "id long, updated int")
    got = rows(Q.expanded(found, links, relations, allowed))
    assert got == [(1, 20, 1), (1, 22, 2)]  # three then, so 21 is not sought


def test_recall(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 7)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, 6), (1, 7), (2, 9), (3, 1)], "query_id long, id long")
    assert rows(Q.recall_and_mrr(ranked, gold)) == [(3, round((0.5 + 0 + 0) / 3, 6), round((0.5 + 1 + 0) / 3, 6), round((0.5 + 1 / 7) / 3, 6))]


def test_cohits(spark):
    logged = spark.createDataFrame([(q, r, i) for q in range(4) for r, i in enumerate([1, 2, 3, 4, 5, 6], 1)] + [(9, 1, 2), (9, 2, 1)], "query_id long, rank int, id long")
    edges = spark.createDataFrame([(1, 2, 0.9), (7, 8, 0.4)], "source long, target long, strength double")
    got = {(a, b): s for a, b, s in rows(Q.reinforced(logged, edges))}
    assert got[(1, 2)] == 1.0 and got[(7, 8)] == 0.4 and got[(3, 5)] == 0.25 and (2, 1) not in got and (1, 6) not in got


# filters


def test_filters(spark):
    df = spark.createDataFrame([(1, '{"sourceProjectPath":"a/b"}', "z"), (2, '{"legacyProject":{"path":"a"}}', "z"), (3, "{bad", "a/bc"), (4, None, None)], "id int, m string, p string")
    path = FL.source_path(F.col("m"), F.col("p"))
    assert [r[0] for r in df.where(FL.in_scope(path, "a/b")).select("id").collect()] == [1]
    assert sorted(r[0] for r in df.where(FL.in_scope(path, "a")).select("id").collect()) == [1, 2, 3]
    assert [r[0] for r in df.where(FL.in_scope(path, "a", False)).select("id").collect()] == [2]
    assert FL.query_terms(" a, b；c。d e f g") == ["a", "b", "c", "d", "e", "f"]
    assert (FL.clamped(None, 20, 40), FL.clamped(0, 20, 40), FL.clamped(99, 20, 40)) == (20, 1, 40)


# life


def test_decay_crosses_steps_in_one_pass(spark):
    data = [(1, "long", 0.8, None, 0.301, "active"), (2, "long", 0.8, "2024-12-30", 0.2, "active"), (3, "short", 0.101, None, 0.2, "active"), (4, "flash", 0.5, None, 0.0101, "active"), (5, "entity", 0.5, None, 0.5, "active"), (6, "flash", 0.5, None, 0.5, "archived")]
    df = spark.createDataFrame(data, "id int, layer string, confidence double, last_hit_at string, decay_factor double, status string").withColumn("last_hit_at", F.to_date("last_hit_at"))
    got = {r["id"]: (r["layer"], round(r["confidence"], 6), round(r["decay_factor"], 6), r["status"]) for r in L.decayed(df, F.lit("2024-12-31").cast("date")).collect()}
    assert got[1] == ("short", 0.792, 0.5, "active")  # falls under 0.3 in this pass, and starts afresh
    assert got[2] == ("long", 0.8, 0.2, "active") and got[3] == ("flash", 0.1, 0.196, "active")
    assert got[4] == ("flash", 0.475, 0.009595, "decayed") and got[5][2] == 0.5 and got[6] == ("flash", 0.5, 0.5, "archived")


def test_quality_and_promotion(spark):
    schema = "id int, title string, content string, layer string, project string, confidence double, decay_factor double, updated string, created string, tags array<string>, source string, kind string, status string, hit_count int"
    good = ("t", "x" * 60, "short", "p", 0.9, 1.0, "2024-12-30", "2024-12-30", ["topic", "b", "c", "d", "e"], "s", "fact", "active", 20)
    bad = ("t", "x", "flash", None, 0.5, 0.4, "2024-01-01", "2024-12-29", ["kind:task"], None, None, "active", 0)
    df = spark.createDataFrame([(1, *good), (2, *bad)], schema).withColumns({"updated": F.to_date("updated"), "created": F.to_date("created")})
    now = F.lit("2024-12-31").cast("date")
    got = {r["id"]: r for r in L.with_quality(df, now).collect()}
    assert (got[1]["quality"], got[1]["maturity"], got[1]["issues"]) == (100, "trusted", [])
    assert got[2]["issues"] == ["sparse_content", "missing_project", "missing_source", "missing_domain_tags", "low_confidence", "decaying", "stale_flash"] and got[2]["quality"] == 100 - 82 and got[2]["maturity"] == "seed"
    asked = spark.createDataFrame([(1, f"q{i}") for i in range(10)] * 2, "id int, query string")
    scored = {r["id"]: r for r in L.dream_scored(df, asked, now).collect()}
    want = 0.30 * 0.9 + 0.24 + 0.15 + 0.15 * np.exp(-1 / 30) + 0.10 * 0.5 + 0.06
    assert scored[1]["score"] == pytest.approx(want) and scored[1]["unique_queries"] == 10 and scored[2]["unique_queries"] == 1
    assert [r["id"] for r in L.promotion_ready(L.dream_scored(df, asked, now)).collect()] == [1]


def test_versions(spark):
    versions = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "a\nc\nd"), (2, 1, "x")], "id int, version long, content string")
    assert rows(L.version_diff(versions)) == [(1, 2, 2, "b", "c"), (1, 2, 3, None, "d")]
    assert rows(L.rolled_back(versions, spark.createDataFrame([(1, 1)], "id int, version long"))) == [(1, 3, "a\nb", "rollback")]
    rows_ = spark.createDataFrame([(1, "t", '{"a":"1","b":"2"}'), (2, "u", None)], "id int, title string, metadata string")
    patches = spark.createDataFrame([(1, None, '{"b":null,"c":"3"}'), (2, "new", None)], "id int, title string, metadata string")
    got = {r["id"]: (r["title"], json.loads(r["metadata"]) if r["metadata"] else None) for r in L.patched(rows_, patches, ["title", "metadata"]).collect()}
    assert got == {1: ("t", {"a": "1", "c": "3"}), 2: ("new", None)}


def test_supersession(spark):
    rows_ = spark.createDataFrame([(1, 0, None), (2, 5, None), (3, 9, None)], "id long, valid_from int, valid_to int")
    edges = spark.createDataFrame([(2, 1, 5), (3, 1, 9), (3, 3, 9), (77, 2, 6), (3, 2, 4)], "source long, target long, effective_at int")
    assert rows(L.superseded(rows_, edges)) == [(1, 0, 5), (2, 5, None), (3, 9, None)]  # unknown, own and earlier than the start close nothing


# graph


def test_relations(spark):
    none = spark.createDataFrame([], "source long, target long, type string, strength double")
    new = spark.createDataFrame([(1, 2, "extends", 0.5, 1), (1, 2, "extends", 0.3, 2), (1, 1, "extends", 0.5, 3), (1, 3, "likes", 0.5, 4), (1, 3, "relates_to", 1.5, 5)], "source long, target long, type string, strength double, place long")
    assert rows(G.relations_set(none, new)) == [(1, 2, "extends", 0.3), (2, 1, "extended_by", 0.3)]
    assert rows(G.relations_raised(none, new.where("type = 'extends'"))) == [(1, 2, "extends", 0.5)]
    assert rows(G.related(spark.createDataFrame([(1, 2, "x", 0.5)], none.schema))) == [(1, 2, "x", "outgoing", 0.5), (2, 1, "x", "incoming", 0.5)]


def test_shared_entities_against_brute_force(spark):
    rnd = random.Random(4)
    links = {(i, rnd.randrange(12)) for i in range(60) for _ in range(rnd.randrange(1, 5))} | {(i, 99) for i in range(100, 130)}
    df = spark.createDataFrame([*links, *list(links)[:20]], "id long, entity long")
    sets = {}
    for i, e in links:
        sets.setdefault(i, set()).add(e)
    want = []
    for i, own in sets.items():
        best = sorted(((-len(own & o), j) for j, o in sets.items() if j != i and own & o))[:10]
        want += [(i, j, -n, round(min(0.95, 0.5 + (-n - 1) * 0.15), 6)) for n, j in best]
    assert rows(G.shared_entities(df)) == sorted(want, key=str)


def test_shared_entities_of_small_sets_meet_in_twos(spark, monkeypatch):
    """Entities held by many in small sets: pairs that share one entity are not all made."""
    rnd = random.Random(5)
    links = {(i, rnd.randrange(6) if rnd.random() < 0.5 else rnd.randrange(40)) for i in range(300) for _ in range(rnd.randrange(1, 4))}
    sets, made = {}, []
    for i, e in links:
        sets.setdefault(i, set()).add(e)
    want = []
    for i, own in sets.items():
        best = sorted(((-len(own & o), j) for j, o in sets.items() if j != i and own & o))[:10]
        want += [(i, j, -n, round(min(0.95, 0.5 + (-n - 1) * 0.15), 6)) for n, j in best]
    shared = G._shared
    monkeypatch.setattr(G, "_shared", lambda *x: made.append(shared(*x)) or made[-1])
    assert rows(G.shared_entities(spark.createDataFrame([*links], "id long, entity long"))) == sorted(want, key=str)
    assert made[0] is not None and made[0].count() < sum(len(a & b) > 0 for a in map(frozenset, sets.values()) for b in map(frozenset, sets.values())) / 4


def test_merging_entities(spark):
    entities = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C")], "id long, name string")
    aliases = spark.createDataFrame([(1, "B"), (4, "see")], "entity_id long, alias string")
    assert rows(G.entity_duplicates(entities, aliases)) == [(2, 1), (3, 1)]
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 3)], "memory_id long, entity_id long")
    relations = spark.createDataFrame([(2, 4), (1, 3), (4, 3)], "source_id long, target_id long")
    kept, links, aliases, relations = G.entities_merged(G.entity_duplicates(entities, aliases), links, aliases, relations, entities)
    assert rows(kept) == [(1, "A"), (4, "C")] and rows(links) == [(10, 1), (11, 1)] and rows(aliases) == [(1, "B"), (4, "see")] and rows(relations) == [(1, 4), (4, 1)]


@pytest.mark.parametrize("block", [3, 25, 4096])
def test_older_candidates_by_a_tree(spark, block):
    rnd = random.Random(block)
    data = [(i, rnd.choice("aab"), rnd.choice([None, rnd.randrange(30)]), rnd.randrange(9), rnd.randrange(40), rnd.choice(["active", "active", "archived"])) for i in range(120)]
    df = spark.createDataFrame(data, "id long, agent_space string, last_hit_at int, updated int, created int, status string").repartition(4)
    want = set()
    for i, space, _, _, made, _ in data[::7]:
        older = [r for r in data if r[1] == space and r[5] == "active" and (r[4], r[0]) < (made, i)]
        older.sort(key=lambda r: (r[2] is None, -(r[2] or 0), -r[3], r[0]))
        want |= {(i, r[0]) for r in older[:5]}
    got = [tuple(r) for r in Y.older_candidates(df.where("id % 7 = 0"), df, 5, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert Y.older_candidates(df.limit(0), df.limit(0)).count() == 0


def test_health_counts(spark):
    rows = [(1, "flash", "active", 1.0, None, 0, ["a"]), (2, "short", "active", 0.5, 1, 3, []), (3, "long", "active", 1.0, None, 0, ["sensitivity:redacted"]), (4, "long", "archived", 0.2, None, 0, [])]
    df = spark.createDataFrame(rows, "id long, layer string, status string, decay_factor double, last_hit_at int, hit_count int, tags array<string>")
    counts = spark.createDataFrame([(3, 10, 1, 0, 2)], "duplicates long, orphans long, conflicts long, produced long, loop_runs long")
    (r,) = L.health(df, counts).collect()
    assert (r["unique_score"], r["linked_score"], r["agreed_score"], r["fresh_score"], r["flow"], r["score"]) == (85, 70, 90, 98, 65, 82)
    assert (r["flash"], r["short"], r["long"], r["decaying"], r["long_zero_hit"], r["redacted"]) == (1, 1, 1, 1, 1, 1)


def test_deep_trees_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(10_000)]
    ring = [(20_000 + i, 20_000 + (i + 1) % 7) for i in range(7)] + [(30_000, 20_003), (40_000, 40_000), (50_000, 49_999), (50_001, 50_000)]
    nodes = spark.createDataFrame(chain + ring, "id long, parent_id long")
    assert set(rows(G.roots(nodes))) == {(i, 0, i) for i in range(10_000)}
    assert set(rows(G.unrooted(nodes))) == set([(20_000 + i, "cycle") for i in range(7)] + [(30_000, "cycle"), (40_000, "cycle"), (50_000, "missing"), (50_001, "missing")])
    named = nodes.where("id < 300 OR id >= 20000").withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    got = {r["id"]: (r["path"], r["depth"]) for r in G.paths(named).collect()}
    assert len(got) == 300 and got[299] == ("/".join(f"n{i}" for i in range(300)), 299)
    assert G.paths(named.limit(0)).count() == 0 and G.roots(nodes.limit(0)).count() == 0


def test_cascade_and_promotion(spark):
    rnd = random.Random(4)
    parent = {i: rnd.randrange(i) if i > 3 else None for i in range(200)}
    removed = {i for i in parent if rnd.random() < 0.3}
    nodes = spark.createDataFrame([*parent.items()], "id long, parent_id long").withColumn("name", F.lit("x"))
    marked = spark.createDataFrame([(i,) for i in removed], "id long")

    def above(i):
        while i is not None:
            yield i
            i = parent[i]

    assert {r["id"] for r in G.subtree(nodes, marked).collect()} == {i for i in parent if removed & set(above(i))}
    want = {i: next((p for p in [*above(i)][1:] if p not in removed), None) for i in parent if i not in removed}
    left = G.without_promoting(nodes, marked)
    assert left.columns == nodes.columns and {r["id"]: r["parent_id"] for r in left.collect()} == want


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None, "R"), ("a", "r", "A"), ("b", "a", "B"), ("x", "gone", "X")], "id string, parent_id string, name string")
    assert rows(G.paths(nodes)) == [("a", "R/A", 1), ("b", "R/A/B", 2), ("r", "R", 0)]
    assert rows(G.unrooted(nodes)) == [("x", "missing")]
    tree = spark.createDataFrame([("R/A", 1), ("R/A/B", 2), ("R/AB", 1)], "path string, depth int")
    assert rows(G.moved_subtree(tree, "R/A", "S")) == [("R/AB", 1), ("S", 0), ("S/B", 1)]
    assert spark.createDataFrame([("a / b//c",)], "p string").select(G.ancestors(F.col("p"))).first()[0] == ["a", "a/b", "a/b/c"]


# duplicates


def test_uniform_numbers_and_planes():
    # the first numbers of the generator from seed 1, worked out by hand in 32-bit arithmetic
    def plain(seed, n):
        a, out = seed, []
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t = ((t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
            out.append(((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296)
        return out

    assert D.uniform(0x5EED, 50).tolist() == plain(0x5EED, 50)
    planes = D.hyperplanes(7)
    assert planes.shape == (128, 7) and np.allclose(np.linalg.norm(planes, axis=1), 1, atol=1e-6)


def test_lsh_pairs_against_all_pairs(spark):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(150, 16))
    v[50:100] = v[:50] + rnd.normal(size=(50, 16)) * 0.15
    v[100:120] = v[0]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    distinct = [i for i in range(150) if not 100 <= i < 120]
    want = {(a, b) for a in distinct for b in distinct if a < b and unit[a] @ unit[b] >= 0.9}
    assert {(r["one"], r["two"]) for r in D.duplicate_pairs(df, 0.9).collect()} == want and len(want) > 30
    assert {r["id"]: r["class"] for r in D.vector_classes(df).collect()}[110] == 0


def test_crowded_buckets_lose_nothing_near(spark, monkeypatch):
    monkeypatch.setattr(D, "CROWD", 4)
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(1, 12)) + rnd.normal(size=(60, 12)) * 0.12
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if unit[a] @ unit[b] >= 0.95}
    got = {(r["one"], r["two"]) for r in D.duplicate_pairs(df, 0.95).collect()}
    assert got <= want and len(got) / len(want) > 0.99


def test_no_pair_at_the_threshold_is_lost(spark, monkeypatch):
    """4,000 pairs at cosine 0.9 exactly in buckets that all are crowded."""
    monkeypatch.setattr(D, "CROWD", 8)
    rnd = np.random.default_rng(8)
    a, b = rnd.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9000001 * a + np.sqrt(1 - 0.9000001**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)] + [(10_000 + i, x.tolist()) for i, x in enumerate(b)], "id long, embedding array<double>").repartition(8)
    found = {(r["one"], r["two"]) for r in D.duplicate_pairs(df, 0.9).collect()}
    assert found >= {(i, 10_000 + i) for i in range(4000)}


def test_lengths_follow_one_another(spark, monkeypatch):
    """A hot group among others: short keys find some pairs, longer ones those of the crowded."""
    monkeypatch.setattr(D, "CROWD", 20)
    rnd = np.random.default_rng(9)
    v = np.concatenate([rnd.normal(size=(1, 32)) + 0.2 * rnd.normal(size=(80, 32)), np.repeat(rnd.normal(size=(40, 32)), 2, axis=0) + 0.1 * rnd.normal(size=(80, 32))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for threshold in (0.78, 0.9, 0.99):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
        want = {(i, j) for i in range(160) for j in range(i + 1, 160) if unit[i] @ unit[j] >= threshold}
        assert {(r["one"], r["two"]) for r in D.duplicate_pairs(df, threshold).collect()} == want


def test_keepers_by_rounds_equal_those_row_by_row(spark):
    rnd = random.Random(3)
    pairs = {tuple(rnd.sample(range(300), 2)) for _ in range(500)} | {(1000 + i, 1001 + i) for i in range(12)} | {(7, 7)}
    place = {i: rnd.randrange(50) for p in pairs for i in p}
    df, order = spark.createDataFrame([*pairs], "one long, two long"), spark.createDataFrame([*place.items()], "id long, place long")
    proper = [p for p in pairs if p[0] != p[1]]
    own = {i for p in proper for i in p}
    want = D._kept({i: (place[i], i) for i in own}, proper)
    assert dict(rows(D.keepers_by_rounds(df, order))) == want
    components = D.labelled(df.where("one != two"))
    assert dict(rows(D.greedy_keepers(df.where("one != two"), components, order, most=20))) == want
    assert D.keepers_by_rounds(df.limit(0), order).count() == 0


def test_greedy_keepers_in_chains(spark):
    rnd = random.Random(2)
    pairs = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(45)} | {(50, 51), (51, 52)}  # a chain whose ends are not alike
    place = {i: rnd.randrange(100) for p in pairs for i in p}
    df = spark.createDataFrame([*pairs], "one long, two long")
    components = D.labelled(df)
    root = {}
    for i in place:
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                for u, w in ((a, b), (b, a)):
                    if u == x and w not in seen:
                        seen.add(w)
                        todo.append(w)
        root[i] = min(seen)
    assert {r["id"]: r["component"] for r in components.collect()} == root
    got = dict(rows(D.greedy_keepers(df, components, spark.createDataFrame([*place.items()], "id long, place long"))))
    keeper = {}
    for i in sorted(place, key=lambda i: (place[i], i)):
        if i not in keeper:
            keeper[i] = i
            for j in place:
                if j not in keeper and tuple(sorted((i, j))) in pairs:
                    keeper[j] = i
    assert got == keeper


def test_duplicate_rules(spark):
    kind = "struct<title:string,content:string,tags:array<string>>"
    cases = [
        ((("Same", "x", []), ("same ", "y", [])), True), ((("a", "one two three", []), ("b", "ONE two three", [])), True), ((("a", "x" * 60, []), ("b", "y" + "x" * 60, [])), True),
        ((("t", "a b c d e f g", ["k", "l"]), ("u", "a b c d e f h", ["K", "l"])), True), ((("t", "a b c d e f g", []), ("u", "a b c d e f h", [])), False), ((("t", "a", []), ("u", "b", [])), False),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    own = lambda c: D.comparable(F.col(c)["title"], F.col(c)["content"], F.col(c)["tags"]).alias(c)
    assert [r[0] for r in df.orderBy("i").select(own("a"), own("b")).select(D.is_duplicate("a", "b")).collect()] == [w for _, w in cases]


def test_alike_texts_meet(spark):
    rnd = random.Random(1)
    data = [(i, " ".join(rnd.choices([f"w{k}" for k in range(400)], k=60))) for i in range(40)]
    data += [(100 + i, " ".join([*t.split()[:52], "x", "y"])) for i, t in data[:20]] + [(900, ""), (901, None)]
    got = {(r["one"], r["two"]) for r in D.alike_candidates(spark.createDataFrame(data, "id long, t string"), "t").collect()}
    assert {(i, 100 + i) for i in range(20)} <= got and len(got) < 400


# loops


def test_breaker(spark):
    def run(name, spec):
        return [(name, i, s != ".", s, 10.0) for i, s in enumerate(spec)]

    data = run("same", "abbb") + run("mixed", "abaab") + run("reset", "aa.aa.a") + run("long", "." * 12) + run("spend", "." * 6) + run("other", "aab.b.bb")
    df = spark.createDataFrame(data, "run string, ts int, failed boolean, signature string, tokens double")
    got = {r["run"]: (r["ts"], r["reason"]) for r in P.tripped(df, "run", ["ts"]).collect()}
    assert got == {"same": (3, "stagnation"), "mixed": (4, "no-progress"), "long": (9, "max-iterations")}
    got = {r["run"]: (r["ts"], r["reason"]) for r in P.tripped(df, "run", ["ts"], token_budget=50).collect()}
    assert got["spend"] == (4, "token-budget") and got["same"] == (3, "stagnation") and got["mixed"] == (4, "no-progress")


def test_starts_and_checkpoints(spark):
    df = spark.createDataFrame([(1, "k", '{"a":1,"b":2}'), (2, "k", '{"b":2, "a":1}'), (3, "k", '{"a":2}'), (4, "j", "{}")], "place long, key string, request string")
    assert rows(P.started(df)) == [(1, "k", 1, "started"), (2, "k", 1, "replayed"), (3, "k", None, "conflict"), (4, "j", 4, "started")]
    writes = [("r", 1, 0, "w1", 0, 60), ("r", 2, 1, "w2", 30, 60), ("r", 3, 0, "w1", 40, 60), ("r", 4, 1, "w1", 50, 60), ("r", 5, 2, "w2", 110, 60)]
    got = rows(P.checkpointed(spark.createDataFrame(writes, "run string, place long, expected long, worker string, at long, lease_seconds long"), "run"))
    assert got == [("r", 1, True, 1), ("r", 2, False, 1), ("r", 3, False, 1), ("r", 4, True, 2), ("r", 5, True, 3)]


# mail


def test_digests(spark):
    linked = spark.createDataFrame([(1, 10, "t", "c", 5, None), (1, 11, "t", "d", 9, "x"), (2, 12, "t", "e", 2, None), (3, 13, "t", "f", 9, "mailbox-archive")], "thread_id long, id long, title string, content string, updated int, source string")
    threads = spark.createDataFrame([(1, 4), (2, 4), (3, 1)], "thread_id long, last_message_at int")
    none = spark.createDataFrame([], "thread_id long, coverage_through int, fingerprint string")
    (due,) = M.digests_due(linked, threads, none).collect()
    assert (due["thread_id"], due["sources"], due["coverage_through"]) == (1, 2, 9)
    same = spark.createDataFrame([(1, 4, due["fingerprint"])], none.schema)
    assert M.digests_due(linked, threads, same).count() == 0
    assert M.digests_due(linked, threads, spark.createDataFrame([(1, 5, "old")], none.schema)).first()["sources"] == 1


def test_attachments_and_work(spark):
    df = spark.createDataFrame([(1, "see\n```log\nx\n```\nand\n```\ny\n```")], "id int, body string")
    r = M.attachments(df).first()
    assert [(b["kind"], b["content"]) for b in r["blocks"]] == [("log", "x"), ("technical", "y")] and "```" not in r["clean"]


# packs


def test_budget_against_plain_python(spark):
    rnd = random.Random(5)
    data = [(p, i, "t" * rnd.randrange(5, 40), "c" * rnd.randrange(0, 1500), rnd.random(), rnd.randrange(9)) for p in range(4) for i in range(60)]
    df = spark.createDataFrame(data, "pack long, id long, title string, content string, score double, updated int")
    got = rows(C.packed(df, 12, 2500))
    want = []
    for p in range(4):
        used, n = 0, 0
        for _, i, title, text, _, _ in sorted((r for r in data if r[0] == p), key=lambda r: (-r[4], -r[5], r[1])):
            if n >= 12 or used >= 2500:
                break
            room = min(900, max(180, 2500 - used - len(title) - 80))
            text = text if len(text) <= room else text[: room - 1].rstrip() + "…"
            if used + len(title) + len(text) + 80 > 2500 and n:
                continue
            n += 1
            used += len(title) + len(text) + 80
            want.append((p, n, i, text))
    assert got == sorted(want, key=str)


def test_expansion_share(spark):
    memories = spark.createDataFrame([(i, "active", "raw_note", "flash", 0) for i in range(20)], "id long, status string, kind string, layer string, hit_count int")
    candidates = spark.createDataFrame([(1, i, 1.0 - i / 100) for i in range(5)], "pack long, id long, score double")
    related = spark.createDataFrame([(i, 10 + i, "relates_to", 0.5 + i / 20) for i in range(5)] + [(0, 19, "contradicts", 1.0), (0, 18, "relates_to", 0.4)], "id long, other long, type string, strength double")
    got = rows(C.expanded(candidates, related, memories))
    assert len(got) == 8 and {r[1] for r in got} - set(range(5)) <= {10, 11, 12, 13, 14}  # three of ten may be expansions
    superseders = spark.createDataFrame([(0, 9), (1, 2)], "superseded long, superseder long")
    new = [r for r in C.promoted(candidates, superseders, memories).collect() if r["id"] == 9]
    assert len(new) == 1 and new[0]["score"] > 1.15


def test_sections_and_budget(spark):
    chosen = spark.createDataFrame([(1, 1, 10, "aa"), (1, 2, 11, "bb"), (1, 3, 12, "cc")], "pack long, place int, id long, content string")
    memories = spark.createDataFrame([(10, "A", "long", "task"), (11, "B", "flash", "raw_note"), (12, "C", "short", "task")], "id long, title string, layer string, kind string")
    got = rows(C.sections(chosen, memories))
    assert got == [(1, 10, "raw_note", "- [flash, 11] B: bb"), (1, 5, "task", "- [long, 10] A: aa\n- [short, 12] C: cc")]
    assert (C.token_budget(None), C.token_budget(10), C.token_budget(99_999)) == (2000, 400, 8000)


def test_divergence_and_hints(spark):
    from tarn.functions import rules as U
    from tarn.operators import cycle as Y
    from tarn.sources.importing import path_hint

    memories = spark.createDataFrame([(1, "storage", "the orders service 改用 postgres"), (2, "storage", "the orders service 继续使用 mysql"), (3, "lunch", "改用 fish")], "id long, title string, content string")
    links = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "entity_id long, id long")
    names = spark.createDataFrame([(7, "DB"), (8, "API")], "entity_id long, name string")
    assert rows(Y.divergent(memories, links, names)) == [(7, 1, 2)]
    assert Y.visible_spaces("a") == ["global", "agent:a"] and Y.visible_spaces("a", "isolated", "u") == ["user:u:agent:a"]
    df = spark.createDataFrame([(1, '{"project":"P"}', "/x/y.md"), (2, "{}", "/x/y.md"), (3, None, "y.md")], "i int, m string, p string")
    assert [r[0] for r in df.orderBy("i").select(path_hint(F.col("m"), F.col("p"))).collect()] == ["P", "/x", None]
    grams = spark.createDataFrame([("用缓存 ok",), ("plain",)], "t string").select(U.with_grams(F.col("t")).alias("g"))
    assert rows(grams) == [("plain",), ("用缓存 ok 用缓 缓存",)]
    runs = spark.createDataFrame([(1, "w", 5), (2, "w", 9), (3, None, 1)], "run int, lease_owner string, lease_expires_at int")
    assert [r["run"] for r in P.expired_leases(runs, F.lit(5)).collect()] == [1]


def test_strangers_that_meet_do_not_grow_with_the_rows(spark, monkeypatch):
    """Random vectors, four times as many: pairs that share a key go up as the rows do, not as their square."""
    met = []
    once = D._alike_sides
    monkeypatch.setattr(D, "_alike_sides", lambda pairs, *rest: met.append(pairs.count()) or once(pairs, *rest))
    rnd = np.random.default_rng(10)
    for n in (60_000, 240_000):
        data = pa.table({"id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(rnd.normal(size=n * 32)), 32).cast(pa.list_(pa.float64()))})
        D.duplicate_pairs(spark.createDataFrame(data), 0.999)
    assert met[1] < 8 * met[0]


def test_expansion_deals_out_only_the_newest(spark):
    """Rows met by many ways, repeated links and what was found already, against plain Python; most are cut where they are met."""
    rnd = random.Random(11)
    links = [(rnd.randrange(300), rnd.randrange(40)) for _ in range(900)]
    relations = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(50)]
    updated = {i: rnd.randrange(50) for i in range(290)}
    found = [(q, i) for q in range(20) for i in sorted(updated, key=lambda i: (-updated[i], i))[: q % 4]]
    near = {(a, b) for x, y in relations for a, b in ((x, y), (y, x))}
    want = []
    for q in {q for q, _ in found}:
        have = {i for r, i in found if r == q}
        if len(have) < 3:
            seeds = {e for m, e in links if m in have}
            seeds |= {b for a, b in near if a in seeds}
            met = sorted({m for m, e in links if e in seeds and m in updated} - have, key=lambda i: (-updated[i], i))
            want += [(q, i, r + 1) for r, i in enumerate(met[:4])]
    df = lambda rows, cols: spark.createDataFrame(rows, cols).repartition(3)
    got = Q.expanded(df(found, "query_id long, id long"), df(links + links[:99], "memory_id long, entity_id long"), df(relations * 2, "source_id long, target_id long"), df(sorted(updated.items()), "id long, updated long"), most=4, rounds=1)
    assert rows(got) == sorted(want, key=str) and len(want) > 20
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "dense_rank" in plan and "Partial" in plan[plan.index("dense_rank") :]
