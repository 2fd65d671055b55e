"""Queries on scans, filters, joins, aggregates, windows and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import graph as G
from tarn.operators import relational as R
from tarn.plans.registry import query
from tarn.plans.searching import MEM
from tarn.sources.importing import import_report, new_rows
from tarn.sources.tables import memories, table


@query("layer_stats", f"WITH {MEM} SELECT l.layer, count(mem.id) AS n, round(coalesce(avg(confidence), 0), 6) AS confidence FROM (VALUES ('flash'), ('short'), ('long'), ('entity')) l(layer) LEFT JOIN mem USING (layer) GROUP BY 1")
def layer_stats(spark, sf_dir):
    layers = spark.createDataFrame([("flash",), ("short",), ("long",), ("entity",)], "layer string")
    found = memories(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    return F.broadcast(layers).join(found, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("confidence"))


@query("list_page", f"WITH {MEM} SELECT id, title, layer, created FROM mem ORDER BY created DESC, id LIMIT 50 OFFSET 100")
def list_page(spark, sf_dir):
    return memories(spark, sf_dir).select("id", "title", "layer", "created").orderBy(F.desc("created"), "id").offset(100).limit(50)


@query("filtered_scan", f"WITH {MEM} SELECT id, project, confidence FROM mem WHERE layer = 'long' AND agent_space IN ('en', 'de') AND confidence >= 0.8 AND created BETWEEN DATE '2024-02-01' AND DATE '2024-06-30'")
def filtered_scan(spark, sf_dir):
    keep = (F.col("layer") == "long") & F.col("agent_space").isin("en", "de") & (F.col("confidence") >= 0.8) & F.col("created").between("2024-02-01", "2024-06-30")
    return memories(spark, sf_dir).where(keep).select("id", "project", "confidence")


@query("anti_unlabeled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unlabeled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("semi_labeled", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_labeled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("subtree_scope", """SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE starts_with(r_name || '/' || n_name || '/' || c_name, 'EUROPE/') OR starts_with(r_name || '/' || n_name || '/' || c_name, 'ASIA/JAPAN/')""")
def subtree_scope(spark, sf_dir):
    tree = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = tree.select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))
    roots = spark.createDataFrame([("EUROPE",), ("ASIA/JAPAN",)], "path string")
    return R.subtree(nodes, roots).select("c_custkey", "path").distinct()


@query("stratified_window", """WITH a AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300), b AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200), c AS (SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 1000)
SELECT o_orderkey FROM a UNION SELECT o_orderkey FROM b UNION SELECT o_orderkey FROM c""")
def stratified_window(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    best = lambda c, n: orders.orderBy(F.desc(c), "o_orderkey").limit(n).select("o_orderkey")
    return best("o_totalprice", 300).union(best("o_orderdate", 200)).union(best("o_custkey", 1000)).distinct()


@query("cooccur_top", """WITH l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS e FROM lineitem),
c AS (SELECT a.id, b.id AS other, count(*) AS shared FROM l a JOIN l b ON a.e = b.e AND a.id != b.id GROUP BY 1, 2)
SELECT id, other, shared, round(CAST(least(0.95, 0.5 + (shared - 1) * 0.15) AS DOUBLE), 6) AS strength FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) <= 10""")
def cooccur_top(spark, sf_dir):
    """Each order's ten others that share most parts."""
    return G.shared_entities(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("entity")))


@query("edge_rollup", """SELECT least(l_partkey, l_suppkey) AS one, greatest(l_partkey, l_suppkey) AS two, count(*) AS links, round(avg(CAST(1 - l_discount AS DOUBLE)), 6) AS mean_strength
FROM lineitem WHERE l_partkey != l_suppkey GROUP BY 1, 2""")
def edge_rollup(spark, sf_dir):
    return R.edge_rollup(table(spark, sf_dir, "lineitem").withColumn("s", 1 - F.col("l_discount")), "l_partkey", "l_suppkey", "s")


@query("distinct_queries", "SELECT user_id AS memory_id, count(DISTINCT event_type) AS queries, count(*) AS hits, greatest(1, CAST(round(count(*) * 0.6) AS BIGINT)) AS fallback FROM events GROUP BY 1")
def distinct_queries(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("memory_id"))
    return events.agg(F.countDistinct("event_type").alias("queries"), F.count("*").alias("hits"), F.greatest(F.lit(1), F.round(F.count("*") * 0.6).cast("long")).cast("long").alias("fallback"))


@query("having_groups", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) >= 5")
def having_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).where("n >= 5")


@query("cond_sum", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS pending FROM orders GROUP BY 1""")
def cond_sum(spark, sf_dir):
    is_ = lambda s: F.col("o_orderstatus") == s
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(is_("O")).alias("open"), F.count_if(is_("F")).alias("done"), F.round(F.sum(F.when(is_("P"), F.col("o_totalprice")).otherwise(0.0)), 2).alias("pending"))


@query("max_by_pair", "SELECT conv_id, role, max(turn) AS last_turn FROM conversations GROUP BY 1, 2")
def max_by_pair(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("last_turn"))


@query("tag_explode", "SELECT tag, count(*) AS n, count(DISTINCT p_brand) AS brands FROM (SELECT p_brand, lower(unnest(string_split(p_type, ' '))) AS tag FROM part) GROUP BY 1")
def tag_explode(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split(F.lower("p_type"), " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


@query("namespaces", "SELECT split_part(p_type, ' ', 1) AS namespace, array_to_string(list_sort(list(DISTINCT split_part(p_type, ' ', 3))), ',') AS tags FROM part GROUP BY 1")
def namespaces(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("namespace"), F.split_part("p_type", F.lit(" "), F.lit(3)).alias("v"))
    return parts.groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("tags"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull() & (k > 90)).select("event_id", k.alias("k"))


@query("keep_n_per_cluster", "SELECT doc_id, md5(text) AS cluster FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) <= 2")
def keep_n_per_cluster(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("cluster"))
    return R.top_per_key(rows, ["cluster"], [F.desc("doc_id")], 2).select("doc_id", "cluster")


@query("percentile_latency", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_latency(spark, sf_dir):
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"))


@query("import_skip", """WITH d AS (SELECT DISTINCT source, doc_id FROM documents), i AS (SELECT 'src' || (item_id % 20) AS source, item_id FROM benchmark)
SELECT item_id % 20 AS part, count(*) AS found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM d WHERE d.source = i.source AND d.doc_id = i.item_id)) AS added FROM i GROUP BY 1""")
def import_skip(spark, sf_dir):
    """A dry run by (source, source_id): how many of each part are new."""
    incoming = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), F.col("item_id").alias("source_id"))
    existing = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("source_id"), F.lit("active").alias("status"))
    return import_report(incoming, existing, F.col("source_id") % 20).select(F.col("kind").alias("part"), "found", "added")


@query("import_new", "SELECT DISTINCT item_id FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = item_id)")
def import_new(spark, sf_dir):
    existing = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    return new_rows(table(spark, sf_dir, "benchmark"), existing, ["item_id"]).select("item_id")


@query("next_version", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version FROM orders")
def next_version(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version"))


@query("alias_pairs", """WITH f AS (SELECT p_name, min(p_partkey) AS target FROM part GROUP BY 1)
SELECT p_partkey AS source, target FROM part JOIN f USING (p_name) WHERE p_partkey != target UNION SELECT p.p_partkey, a.p_partkey + 1 FROM part a JOIN part p ON p.p_name = 'small ' || split_part(a.p_name, ' ', 2) WHERE p.p_partkey != a.p_partkey + 1 AND a.p_partkey % 40 = 0""")
def alias_pairs(spark, sf_dir):
    """Parts of one name go into the first of them, and those that another's alias names (made by rule for some) into that."""
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    aliases = entities.where("id % 40 = 0").select((F.col("id") + 1).alias("entity_id"), F.concat(F.lit("small "), F.split_part("name", F.lit(" "), F.lit(2))).alias("alias"))
    return G.entity_duplicates(entities, aliases)
