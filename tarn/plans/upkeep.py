"""Queries on filters, graphs, upkeep, duplicates, mail, loops, packs and backups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions.vectors import cosine
from tarn.lineage import kept
from tarn.operators import context as C
from tarn.operators import dedup as D
from tarn.operators import filters as FL
from tarn.operators import graph as G
from tarn.operators import lifecycle as L
from tarn.operators import loops as P
from tarn.operators import mailbox as M
from tarn.operators import relational as R
from tarn.operators import search as Q
from tarn.plans.lifecycle import NOW, today
from tarn.plans.registry import query
from tarn.plans.searching import MEM, STATE
from tarn.sources import backup
from tarn.sources.tables import memories, memory_state, table

KINDS = ["preference", "decision", "task", "procedure", "constraint", "relationship", "event", "concept", "project_fact"]


# filters


@query("tag_filters", f"WITH {STATE} SELECT id, list_contains(tags, 'kind:task') AND list_contains(tags, 'project:alpha') AS has_all, kind IS NOT NULL AND kind = 'fact' AS fact FROM st WHERE list_has_any(tags, ['kind:task', 'project:alpha'])")
def tag_filters(spark, sf_dir):
    rows = memory_state(spark, sf_dir).where(FL.tags_any(F.col("tags"), ["kind:task", "project:alpha"]))
    return rows.select("id", FL.tags_all(F.col("tags"), ["kind:task", "project:alpha"]).alias("has_all"), F.coalesce(F.col("kind") == "fact", F.lit(False)).alias("fact"))


@query("source_scope", "SELECT event_id, 'k/' || (user_id % 5) || '/' || event_type AS path FROM events WHERE user_id % 5 = 3 OR (user_id % 5 = 2 AND event_type = 'view')")
def source_scope(spark, sf_dir):
    """Events as memories: some name their source path in metadata, some an old project's, some have a project only; malformed JSON counts as none."""
    path = F.concat_ws("/", F.lit("k"), (F.col("user_id") % 5).cast("string"), "event_type")
    shape = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(path.alias("sourceProjectPath")))).when(F.col("event_id") % 4 == 1, F.to_json(F.struct(F.struct(path.alias("path")).alias("legacyProject")))).when(F.col("event_id") % 4 == 2, F.lit("{bad")).otherwise(F.lit(None))
    rows = table(spark, sf_dir, "events").select("event_id", FL.source_path(shape, path).alias("path"))
    return rows.where(FL.in_scope(F.col("path"), "k/3") | FL.in_scope(F.col("path"), "k/2/view", descendants=False))


@query("kind_filter", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'event' ELSE 'raw_note' END AS kind FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1")
def kind_filter(spark, sf_dir):
    """Kinds from metadata, else from tags."""
    meta = F.when(F.col("event_id") % 3 == 0, F.lit('{"memoryKind":"task"}')).otherwise(F.lit("{}"))
    tags = F.when(F.col("event_id") % 3 == 1, F.array(F.lit("x"), F.lit("kind:event"))).otherwise(F.array(F.lit("kind:none")))
    rows = table(spark, sf_dir, "events").select("event_id", FL.memory_kind_of(meta, tags, KINDS).alias("kind"), FL.has_kind(meta, tags, "task").alias("a"), FL.has_kind(meta, tags, "event").alias("b"))
    return rows.where("a OR b").select("event_id", "kind")


@query("entity_filter", "SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY' AND (p_name = 'red widget' OR p_partkey % 10 = 0)")
def entity_filter(spark, sf_dir):
    """Orders linked to a part by its name, or by an alias that every tenth has, and its type."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    aliases = parts.where("id % 10 = 0").select(F.col("id").alias("entity_id"), F.lit("red widget").alias("alias"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"))
    return FL.with_entity(links.select(F.col("memory_id").alias("id")).distinct(), links, parts, aliases, name="red widget", kind="ECONOMY")


@query("ranges", f"WITH {STATE} SELECT id FROM st WHERE created BETWEEN DATE '2024-03-01' AND DATE '2024-05-31' AND updated >= DATE '2024-03-10' AND last_hit_at <= DATE '2024-02-01' AND confidence >= 0.5 AND source = 'import'")
def ranges(spark, sf_dir):
    keep = FL.within(F.col("created"), "2024-03-01", "2024-05-31") & FL.within(F.col("updated"), "2024-03-10") & FL.within(F.col("last_hit_at"), None, "2024-02-01")
    return memory_state(spark, sf_dir).where(keep & (F.col("confidence") >= 0.5) & (F.col("source") == "import")).select("id")


@query("visible_rows", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' OR o_custkey % 7 = 0")
def visible_rows(spark, sf_dir):
    owner = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").where(FL.visible_to(owner, "5-LOW")).select("o_orderkey")


@query("allowed_candidates", f"WITH {STATE}, e AS (SELECT id AS a, id + 1 AS b FROM st WHERE id % 9 = 0) SELECT id FROM st WHERE created <= DATE '2024-06-30' AND (id % 8 != 0 OR created + 60 > DATE '2024-06-30') AND id NOT IN (SELECT b FROM e JOIN st ON st.id = a WHERE status = 'active')")
def allowed_candidates(spark, sf_dir):
    rows = memory_state(spark, sf_dir).select("id", "status", "created", F.lit(None).cast("date").alias("valid_from"), F.when(F.col("id") % 8 == 0, F.date_add("created", 60)).alias("valid_to"))
    edges = rows.where("id % 9 = 0").select(F.col("id").alias("superseder"), (F.col("id") + 1).alias("superseded"))
    return FL.allowed_at(rows.select("id"), rows, edges, F.lit("2024-06-30").cast("date"))


@query("layer_order", f"WITH {STATE} SELECT id, layer FROM st WHERE status = 'active' ORDER BY CASE layer WHEN 'flash' THEN 1 WHEN 'short' THEN 2 WHEN 'long' THEN 3 ELSE 4 END, last_hit_at DESC NULLS LAST, id LIMIT 200")
def layer_order(spark, sf_dir):
    place = F.when(F.col("layer") == "flash", 1).when(F.col("layer") == "short", 2).when(F.col("layer") == "long", 3).otherwise(4)
    return memory_state(spark, sf_dir).where("status = 'active'").orderBy(place, F.desc_nulls_last("last_hit_at"), "id").limit(FL.clamped(500, 20, 200)).select("id", "layer")


# life and upkeep


@query("fading", f"WITH {STATE} SELECT id, layer, decay_factor, date_diff('day', last_hit_at, DATE '{NOW}') AS days_since_hit FROM st WHERE status = 'active' AND decay_factor < 1 AND decay_factor > 0.01")
def fading(spark, sf_dir):
    return L.fading(memory_state(spark, sf_dir), today())


@query("forget_restore", f"""WITH {STATE}, a AS (SELECT id, CASE WHEN id % 17 = 3 THEN 'archived' WHEN id % 17 = 4 THEN 'decayed' ELSE status END AS status, CASE WHEN id % 17 = 4 THEN 0 ELSE confidence END AS confidence FROM st WHERE id % 17 != 5)
SELECT id, CASE WHEN id % 2 = 0 AND status IN ('archived', 'decayed') THEN 'active' ELSE status END AS status, CAST(CASE WHEN id % 2 = 0 AND status IN ('archived', 'decayed') THEN 1 ELSE confidence END AS DOUBLE) AS confidence FROM a""")
def forget_restore(spark, sf_dir):
    rows = memory_state(spark, sf_dir)
    requests = rows.where("id % 17 IN (3, 4, 5)").select("id", F.when(F.col("id") % 17 == 3, "archive").when(F.col("id") % 17 == 4, "decay").otherwise("delete").alias("method"))
    return L.restored(L.forgotten(rows, requests), rows.where("id % 2 = 0").select("id")).select("id", "status", "confidence")


@query("recycle_bin", f"WITH {STATE} SELECT id, status FROM st WHERE status IN ('archived', 'decayed', 'deleted')")
def recycle_bin(spark, sf_dir):
    return L.recycle_bin(memory_state(spark, sf_dir)).select("id", "status")


@query("patched", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 = 0 THEN '{\"a\":\"1\",\"c\":\"9\"}' ELSE '{\"a\":\"1\",\"b\":\"2\"}' END AS metadata FROM orders")
def patched(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit('{"a":"1","b":"2"}').alias("metadata"))
    patches = rows.where("id % 3 = 0").select("id", F.lit("patched").alias("title"), F.lit('{"b":null,"c":"9"}').alias("metadata"))
    return L.patched(rows, patches, ["title", "metadata"])


@query("version_diff", """WITH v AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE text IS NOT NULL), l AS (SELECT conv_id, turn, string_split(previous, chr(10)) AS b, string_split(text, chr(10)) AS a FROM v WHERE previous IS NOT NULL),
i AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS line FROM l) SELECT conv_id AS id, turn AS version, count(*) AS changed FROM i WHERE a[line] IS DISTINCT FROM b[line] GROUP BY 1, 2""")
def version_diff(spark, sf_dir):
    """A conversation's turns as versions: how many lines each changed."""
    versions = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("id"), F.col("turn").alias("version"), F.col("text").alias("content"))
    return L.version_diff(versions).groupBy("id", "version").agg(F.count("*").alias("changed"))


@query("rolled_back", "WITH m AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id AS id, n + 1 AS version, md5(text) AS content FROM conversations JOIN m USING (conv_id) WHERE turn = 0")
def rolled_back(spark, sf_dir):
    versions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("version"), F.col("text").alias("content"))
    wanted = versions.where("version = 0").select("id", "version")
    return L.rolled_back(versions, wanted).select("id", "version", F.md5("content").alias("content"))


@query("supersede_chain", """WITH v AS (SELECT o_orderkey AS id, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders)
SELECT id, valid_from, CASE WHEN next > valid_from THEN next END AS valid_to FROM v""")
def supersede_chain(spark, sf_dir):
    """Each order is closed by its customer's next one, at that one's date."""
    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lead("o_orderkey").over(along).alias("next"), F.lead("o_orderdate").over(along).alias("at"))
    edges = orders.where("next IS NOT NULL").select(F.col("next").alias("source"), F.col("id").alias("target"), F.col("at").alias("effective_at"))
    return L.superseded(orders.select("id", "valid_from", "valid_to"), edges)


@query("strongest_superseder", f"""WITH {STATE}, e AS (SELECT id AS superseder, id - 1 - id % 5 AS superseded, (id % 4) / 4 AS strength, created FROM st WHERE id % 5 != 0)
SELECT superseded, arg_max(superseder, (strength, created, -superseder)) AS superseder FROM e WHERE superseder IN (SELECT id FROM st WHERE status = 'active' AND created <= DATE '2024-09-01') GROUP BY 1""")
def strongest_superseder(spark, sf_dir):
    rows = memory_state(spark, sf_dir).select("id", "status", "created", F.col("created").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    edges = rows.where("id % 5 != 0").select(F.col("id").alias("superseder"), (F.col("id") - 1 - F.col("id") % 5).alias("superseded"), (F.col("id") % 4 / 4).alias("strength"), "created")
    return L.strongest_superseder(edges, rows, F.lit("2024-09-01").cast("date"))


def _orphan_ids(spark, sf_dir):
    rows = memory_state(spark, sf_dir)
    links = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("memory_id"))
    relations = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source"), (F.col("item_id") * 11).alias("target"))
    threads = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 3).alias("memory_id"))
    return L.orphans(rows, links, relations, threads).select("id")


ORPHANS = f"""{STATE}, orphan AS (SELECT id FROM st WHERE status = 'active' AND layer != 'flash' AND len(tags) = 0 AND NOT independent AND id NOT IN (SELECT l_partkey * 2 FROM lineitem WHERE l_partkey IS NOT NULL)
AND id NOT IN (SELECT item_id FROM benchmark UNION ALL SELECT item_id * 11 FROM benchmark) AND id NOT IN (SELECT conv_id * 3 FROM conversations))"""


@query("orphans", f"WITH {ORPHANS} SELECT id FROM orphan")
def orphans(spark, sf_dir):
    return _orphan_ids(spark, sf_dir)


@query("inspection", f"WITH {ORPHANS} SELECT 'archive' AS task, id FROM st WHERE status = 'active' AND layer = 'flash' AND created <= DATE '{NOW}' - 7 UNION ALL SELECT 'solidify', id FROM st WHERE status = 'active' AND layer = 'short' AND hit_count >= 8 UNION ALL SELECT 'orphan', id FROM orphan")
def inspection(spark, sf_dir):
    return L.inspection(memory_state(spark, sf_dir), _orphan_ids(spark, sf_dir), today())


@query("health", f"""WITH {ORPHANS}, c AS (SELECT count(*) FILTER (status = 'active' AND layer = 'flash') AS flash, count(*) FILTER (status = 'active' AND layer = 'short') AS short, count(*) FILTER (status = 'active' AND layer = 'long') AS long,
count(*) FILTER (status = 'active' AND decay_factor < 1 AND decay_factor > 0.01) AS decaying, count(*) FILTER (status = 'active' AND layer = 'long' AND hit_count = 0) AS zero FROM st),
k AS (SELECT (SELECT count(*) - count(DISTINCT content) FROM st WHERE status = 'active' AND content IS NOT NULL) AS duplicates, (SELECT count(*) FROM orphan) AS orphans,
(SELECT count(*) FROM (SELECT title FROM st WHERE status = 'active' AND content IS NOT NULL GROUP BY 1 HAVING count(DISTINCT content) > 1)) AS conflicts, (SELECT count(*) FROM st WHERE status = 'active' AND layer = 'entity') AS produced, (SELECT count(DISTINCT user_id) FROM events) AS loop_runs),
f AS (SELECT *, greatest(0, 100 - (CASE WHEN short = 0 THEN 25 ELSE 0 END + CASE WHEN flash = 0 THEN 10 ELSE 0 END + floor(zero / greatest(1, long) * 20 + 0.5) + CASE WHEN produced = 0 THEN 15 ELSE 0 END + CASE WHEN loop_runs = 0 THEN 10 ELSE 0 END)) AS flow FROM c, k)
SELECT flash, short, long, decaying, zero AS long_zero_hit, duplicates, orphans, conflicts, CAST(flow AS BIGINT) AS flow, CAST(floor((greatest(0, 100 - 5 * duplicates) + greatest(0, 100 - 3 * orphans) + greatest(0, 100 - 10 * conflicts) + greatest(0, 100 - 2 * decaying) + flow) / 5 + 0.5) AS BIGINT) AS score FROM f""")
def health(spark, sf_dir):
    """Duplicates have the content of another; titles with several contents count as conflicts, entities as produced by dreams, users as runs."""
    rows = memory_state(spark, sf_dir)
    active = rows.where("status = 'active' AND content IS NOT NULL").select("title", F.md5("content").alias("h"))
    same = active.agg((F.count("*") - F.count_distinct("h")).alias("duplicates"))
    conflicts = active.groupBy("title").agg(F.count_distinct("h").alias("n")).where("n > 1").agg(F.count("*").alias("conflicts"))
    produced = rows.agg(F.count_if((F.col("status") == "active") & (F.col("layer") == "entity")).alias("produced"))
    runs = table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("loop_runs"))
    counts = _orphan_ids(spark, sf_dir).agg(F.count("*").alias("orphans"))
    for one in (same, conflicts, produced, runs):  # a row each
        counts = counts.crossJoin(one)
    return L.health(rows, counts).select("flash", "short", "long", "decaying", "long_zero_hit", "duplicates", "orphans", "conflicts", "flow", "score")


@query("consolidation", f"""WITH {STATE}, d AS (SELECT doc_id AS id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1),
p AS (SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN '1 deduplicate' WHEN layer IN ('short', 'long') AND decay_factor < 0.3 AND (last_hit_at IS NULL OR last_hit_at <= DATE '{NOW}' - 60) THEN '2 archive_stale' WHEN layer = 'flash' AND created <= DATE '{NOW}' - 14 THEN '3 archive_flash' WHEN layer = 'short' AND hit_count >= 8 THEN '4 solidify' END AS a FROM st WHERE status = 'active')
SELECT substr(a, 3) AS action, id FROM p WHERE a IS NOT NULL ORDER BY a, id LIMIT 100""")
def consolidation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    again = docs.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where("r > 1")
    return L.consolidation_plan(memory_state(spark, sf_dir), again, today())


@query("hits_recorded", f"WITH {STATE}, h AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT st.id, st.hit_count + coalesce(n, 0) AS hit_count, round(least(1, decay_factor * pow(1.2, coalesce(n, 0))), 6) AS decay_factor FROM st LEFT JOIN h USING (id)")
def hits_recorded(spark, sf_dir):
    logged = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"))
    return Q.with_hits(memory_state(spark, sf_dir), logged, today()).select("id", "hit_count", F.round("decay_factor", 6).alias("decay_factor"))


@query("cohits_reinforced", """WITH h AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS q, event_id % 50 AS id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS rank FROM events QUALIFY rank <= 5),
p AS (SELECT a.id AS source, b.id AS target, count(*) AS n FROM h a JOIN h b ON a.q = b.q AND a.rank < b.rank GROUP BY 1, 2)
SELECT source, target, round(CAST(CASE WHEN source = target - 1 THEN least(1, 0.5 + 0.05 * n) ELSE least(1, 0.2 + 0.05 * (n - 3)) END AS DOUBLE), 6) AS strength FROM p WHERE source = target - 1 OR n >= 3
UNION ALL SELECT i, i + 1, 0.5 FROM range(49) t(i) WHERE (i, i + 1) NOT IN (SELECT (source, target) FROM p)""")
def cohits_reinforced(spark, sf_dir):
    """An hour's events as a search, their ids modulo 50 as hits; neighbours are known edges of 0.5."""
    ranked = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(Window.partitionBy(F.date_trunc("hour", F.col("ts").cast("timestamp"))).orderBy("event_id")))
    logged = ranked.select(F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("query_id"), "rank", (F.col("event_id") % 50).alias("id"))
    edges = spark.range(49).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(0.5).alias("strength"))
    return Q.reinforced(logged, edges)


# graph


@query("relations_set", """WITH e AS (SELECT o_custkey AS source, o_orderkey AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'extends' ELSE 'relates_to' END AS type, (o_orderkey % 10) / 10 AS strength FROM orders WHERE o_custkey != o_orderkey)
SELECT source, target, type, CAST(strength AS DOUBLE) AS strength FROM e UNION ALL SELECT target, source, 'extended_by', CAST(strength AS DOUBLE) FROM e WHERE type = 'extends'""")
def relations_set(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "extends").otherwise("relates_to")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), kind.alias("type"), (F.col("o_orderkey") % 10 / 10).alias("strength"), F.col("o_orderkey").alias("place"))
    bad = new.select("source", F.col("source").alias("target"), "type", "strength", "place").unionByName(new.withColumn("type", F.lit("likes")))
    return G.relations_set(new.limit(0).drop("place"), new.unionByName(bad))


@query("relations_raised", "SELECT l_partkey AS source, l_suppkey AS target, 'relates_to' AS type, max(CAST(l_discount AS DOUBLE)) AS strength FROM lineitem WHERE l_partkey != l_suppkey GROUP BY 1, 2")
def relations_raised(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("relates_to").alias("type"), F.col("l_discount").cast("double").alias("strength"), "l_linenumber")
    return G.relations_raised(edges.where("l_linenumber = 1 AND source != target").drop("l_linenumber"), edges.drop("l_linenumber"))


@query("related", "WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT a AS id, b AS other, 'outgoing' AS direction FROM e UNION ALL SELECT b, a, 'incoming' FROM e")
def related(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("relates_to").alias("type"), F.lit(1.0).alias("strength")).distinct()
    return G.related(edges).select("id", "other", "direction")


@query("weakened", "SELECT l_orderkey, l_linenumber, round(CAST(l_discount AS DOUBLE) * 10 * 0.97, 6) AS strength FROM lineitem WHERE round(CAST(l_discount AS DOUBLE) * 10 * 0.97, 6) >= 0.2")
def weakened(spark, sf_dir):
    return G.weakened(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount").cast("double") * 10).alias("strength")))


@query("undirected", """WITH e AS (SELECT least(l_partkey, l_suppkey) AS one, greatest(l_partkey, l_suppkey) AS two, l_returnflag AS type, CAST(l_discount AS DOUBLE) AS s FROM lineitem WHERE l_partkey != l_suppkey), t AS (SELECT one, two, type, count(*) AS n, sum(s) AS s FROM e GROUP BY 1, 2, 3)
SELECT one, two, CAST(sum(n) AS BIGINT) AS links, round(sum(s) / sum(n), 6) AS mean_strength, arg_min(type, (-n, type)) AS type FROM t GROUP BY 1, 2""")
def undirected(spark, sf_dir):
    return G.undirected(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_discount").cast("double").alias("strength")))


@query("entities_merged", """WITH f AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), m AS (SELECT p_partkey, k FROM part JOIN f USING (p_name)) SELECT DISTINCT l_orderkey AS memory_id, k AS entity_id FROM lineitem JOIN m ON l_partkey = p_partkey""")
def entities_merged(spark, sf_dir):
    """The links after all parts of one name became the first of them."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    no_alias, no_relation = spark.createDataFrame([], "entity_id long, alias string"), spark.createDataFrame([], "source_id long, target_id long")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"))
    links = links.join(parts.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("memory_id", "entity_id")
    merges = G.entity_duplicates(parts, no_alias)
    return G.entities_merged(merges, links, no_alias, no_relation, parts)[1]


@query("project_tree", """SELECT 'c' || c_custkey AS id, r_name || '/' || n_name || '/' || c_name AS path, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, 0 FROM region""")
def project_tree(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name")))
    return G.paths(nodes)


@query("moved_subtree", "SELECT c_custkey, CASE WHEN r_name = 'ASIA' THEN 'OLD/' || r_name || '/' || n_name ELSE r_name || '/' || n_name END AS path, CASE WHEN r_name = 'ASIA' THEN 2 ELSE 1 END AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def moved_subtree(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit(1).alias("depth"))
    return G.moved_subtree(rows, "ASIA", "OLD/ASIA")


@query("project_similarity", """WITH m AS (SELECT DISTINCT p_type AS project, split_part(p_name, ' ', 1) AS entity FROM part), s AS (SELECT project, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.project AS one, b.project AS two, count(*) AS shared FROM m a JOIN m b ON a.entity = b.entity AND a.project < b.project GROUP BY 1, 2)
SELECT one, two, shared, round(shared / (x.n + y.n - shared), 6) AS similarity FROM p JOIN s x ON x.project = one JOIN s y ON y.project = two WHERE shared / (x.n + y.n - shared) >= 0.15 OR shared >= 2""")
def project_similarity(spark, sf_dir):
    return G.project_similarity(table(spark, sf_dir, "part").select(F.col("p_type").alias("project"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("entity")))


@query("order_chains", """WITH o AS (SELECT o_orderkey AS id, row_number() OVER w AS r, first_value(o_orderkey) OVER w AS root FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT id, root, r - 1 AS depth FROM o""")
def order_chains(spark, sf_dir):
    """Each order under its customer's one before it: a tree as deep as a customer's orders are many."""
    return G.roots(_order_tree(spark, sf_dir))


@query("subtree_deleted", """WITH o AS (SELECT o_orderkey AS id, max(o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gone FROM orders) SELECT id FROM o WHERE gone""")
def subtree_deleted(spark, sf_dir):
    """A cascade: urgent orders, and all that stand under them."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return G.subtree(_order_tree(spark, sf_dir), urgent)


@query("children_promoted", """WITH o AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id FROM orders WHERE o_orderpriority != '1-URGENT') SELECT id, parent_id FROM o""")
def children_promoted(spark, sf_dir):
    """Urgent orders taken out: what stood under them goes to the nearest order above that stays."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return G.without_promoting(_order_tree(spark, sf_dir), urgent)


def _order_tree(spark, sf_dir):
    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(along).alias("parent_id"))


# duplicates


@query("pair_cosine", "SELECT a.vec_id AS one, b.vec_id AS two, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("one"), F.col("embedding").alias("a"))
    other = rows.select((F.col("one") - 1).alias("one"), F.col("one").alias("two"), F.col("a").alias("b"))
    return rows.join(other, "one").select("one", "two", F.round(cosine("a", "b"), 6).alias("similarity"))


# every vector and, far up among the ids, a shaken copy of it
SHAKEN = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + 0.05 * sin(vec_id * 7 + i)) FROM embeddings)"""


def _shaken(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # within a lambda, a name means an alias of the same select before it means a column
    copies = rows.select("id", F.transform("embedding", lambda x, i: x + 0.05 * F.sin(F.col("id") * 7 + i + 1)).alias("embedding"))
    return rows.withColumn("k", F.lit(0)).unionByName(copies.select((F.col("id") + 1000000).alias("id"), "embedding", F.lit(1).alias("k")))


@query("lsh_pairs", f"WITH {SHAKEN} SELECT a.id AS one, b.id AS two, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.9")
def lsh_pairs(spark, sf_dir):
    """Pairs as near as 0.9. The buckets miss such a pair with probability under one in a billion; the SQL compares all."""
    return D.duplicate_pairs(_shaken(spark, sf_dir), 0.9).select("one", "two", F.round("similarity", 6).alias("similarity"))


@query("greedy_dedup", "SELECT vec_id + 1000000 * k AS id, vec_id AS keeper FROM embeddings, (VALUES (0), (1)) t(k)")
def greedy_dedup(spark, sf_dir):
    """Keepers among near vectors, in the order of their ids: each vector keeps its copy, and the vectors near it that none before it keeps.

    The SQL takes for granted that a vector is near its own copy only.
    """
    # a copy may have the number of a vector of the table: these keys tell them apart, in the order of the numbers
    rows = _shaken(spark, sf_dir).select((F.col("id") * 2 + F.col("k")).alias("id"), "embedding")
    pairs = kept(D.duplicate_pairs(rows.where(D.has_direction("embedding")), 0.9).select("one", "two"), "pairs")
    components = D.labelled(pairs)
    keepers = D.greedy_keepers(pairs, components, components.select("id", F.col("id").alias("place")))
    return D.every_keeper(rows, keepers).select(*[F.shiftright(c, 1).alias(c) for c in ("id", "keeper")])


@query("chunk_vectors", "SELECT vec_id AS id, max(vec_id) OVER (PARTITION BY embedding) = vec_id AS last FROM embeddings")
def chunk_vectors(spark, sf_dir):
    """Classes of equal vectors: whether each row is the last of its class."""
    rows = D.vector_classes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    last = rows.groupBy("class").agg(F.max("id").alias("m"))
    return rows.join(last, "class").select("id", (F.col("id") == F.col("m")).alias("last"))


# mail


def _mail(spark, sf_dir):
    """Conversations as threads and messages: who sent what, and receipts by rule."""
    turns = table(spark, sf_dir, "conversations")
    messages = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("thread_id"), F.col("role").alias("sender_id"), F.array(F.lit("agent:a"), F.lit("human")).alias("recipient_ids"), F.when(F.col("turn") == 5, "draft").otherwise("sent").alias("status"), F.col("text").alias("body"), F.col("turn").cast("long").alias("turn"))
    receipts = messages.where("turn % 2 = 0").select(F.col("id").alias("message_id"), F.lit("agent:a").alias("recipient_id"), F.col("turn").alias("delivered_at"), F.when(F.col("turn") != 2, F.col("turn")).alias("read_at"))
    threads = messages.groupBy(F.col("thread_id").alias("id")).agg(F.max("turn").alias("last_message_at")).withColumns({"folder": F.when(F.col("id") % 4 == 0, "archive").otherwise("inbox"), "starred": F.col("id") % 3 == 0, "snoozed_until": F.when(F.col("id") % 5 == 0, F.lit(9)).cast("long"), "subject": F.concat(F.lit("thread "), F.col("id").cast("string")), "current_summary": F.lit("")})
    return threads, messages, receipts


@query("mail_folders", """WITH t AS (SELECT conv_id AS id, conv_id % 4 = 0 AS archived, conv_id % 3 = 0 AS starred, conv_id % 5 = 0 AS snoozed, bool_or(role = 'assistant' AND turn != 5) AS sent, bool_or(turn = 5) AS draft FROM conversations GROUP BY 1)
SELECT 'inbox' AS folder, id FROM t WHERE NOT archived AND NOT snoozed UNION ALL SELECT 'archive', id FROM t WHERE archived UNION ALL SELECT 'starred', id FROM t WHERE starred UNION ALL SELECT 'snoozed', id FROM t WHERE snoozed
UNION ALL SELECT 'sent', id FROM t WHERE sent UNION ALL SELECT 'drafts', id FROM t WHERE draft UNION ALL SELECT 'all', id FROM t""")
def mail_folders(spark, sf_dir):
    threads, messages, _ = _mail(spark, sf_dir)
    out = None
    for folder in ("inbox", "archive", "starred", "snoozed", "sent", "drafts", "scheduled", "all"):
        rows = M.in_folder(threads, messages, folder, "assistant", F.lit(7)).select(F.lit(folder).alias("folder"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("thread_page", "SELECT conv_id AS id, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY max(turn) DESC, conv_id LIMIT 100 OFFSET 20")
def thread_page(spark, sf_dir):
    threads, messages, _ = _mail(spark, sf_dir)
    return M.thread_list(threads, messages, 100, 20).select("id", "messages")


@query("thread_search", "SELECT DISTINCT conv_id AS id FROM conversations WHERE contains(lower(coalesce(text, '')), 'retion') OR contains('thread ' || conv_id, 'retion')")
def thread_search(spark, sf_dir):
    threads, messages, _ = _mail(spark, sf_dir)
    return M.matching_threads(threads, messages, " ReTion ").select("id")


@query("mail_readers", "SELECT conv_id AS thread_id, 'agent:a' AS recipient_id, CAST(max(turn) AS BIGINT) AS read_at FROM conversations WHERE turn % 2 = 0 AND turn != 2 GROUP BY 1")
def mail_readers(spark, sf_dir):
    _, messages, receipts = _mail(spark, sf_dir)
    return M.readers(messages, receipts)


@query("mail_participants", "SELECT DISTINCT conv_id AS thread_id, role AS participant FROM conversations UNION SELECT DISTINCT conv_id, unnest(['agent:a', 'human']) FROM conversations")
def mail_participants(spark, sf_dir):
    _, messages, receipts = _mail(spark, sf_dir)
    return M.participants(messages, receipts)


@query("mail_unread", "SELECT conv_id AS thread_id, count(*) FILTER (turn != 5 AND (turn % 2 = 1 OR turn = 2)) AS unread FROM conversations GROUP BY 1")
def mail_unread(spark, sf_dir):
    _, messages, receipts = _mail(spark, sf_dir)
    return M.unread(messages, receipts, F.lit("agent:a"))


@query("mail_marked_read", "SELECT conv_id * 1000 + turn AS message_id, CASE WHEN conv_id % 2 = 0 AND turn != 5 THEN 99 WHEN turn % 2 = 0 AND turn != 2 THEN turn END::BIGINT AS read_at FROM conversations WHERE turn % 2 = 0 OR (conv_id % 2 = 0 AND turn != 5)")
def mail_marked_read(spark, sf_dir):
    threads, messages, receipts = _mail(spark, sf_dir)
    reads = threads.where("id % 2 = 0").select(F.col("id").alias("thread_id"), F.lit("agent:a").alias("recipient_id"), F.lit(99).cast("long").alias("at"))
    return M.marked_read(receipts, messages, reads).select("message_id", "read_at")


@query("mail_stats", "WITH t AS (SELECT DISTINCT conv_id AS id FROM conversations) SELECT count(*) FILTER (id % 4 != 0) AS inbox, count(*) FILTER (id % 4 = 0) AS archive, CAST(0 AS BIGINT) AS trash, count(*) FILTER (id % 3 = 0) AS starred, (SELECT count(*) FROM conversations WHERE turn = 5) AS drafts FROM t")
def mail_stats(spark, sf_dir):
    threads, messages, _ = _mail(spark, sf_dir)
    return M.stats(threads, messages)


@query("digests_due", "WITH m AS (SELECT conv_id, turn FROM conversations WHERE turn > CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 3 END) SELECT conv_id AS thread_id, count(*) AS sources, CAST(max(turn) AS BIGINT) AS coverage_through FROM m GROUP BY 1")
def digests_due(spark, sf_dir):
    """Messages as linked memories: even threads were covered up to turn 1, others count from turn 3."""
    threads, messages, _ = _mail(spark, sf_dir)
    linked = messages.select("thread_id", "id", F.col("sender_id").alias("title"), F.col("body").alias("content"), F.col("turn").alias("updated"), F.lit("x").alias("source"))
    known = threads.select(F.col("id").alias("thread_id"), F.lit(3).cast("long").alias("last_message_at"))
    last = threads.where("id % 2 = 0").select(F.col("id").alias("thread_id"), F.lit(1).cast("long").alias("coverage_through"), F.lit("old").alias("fingerprint"))
    return M.digests_due(linked, known, last).select("thread_id", "sources", "coverage_through")


@query("unorganized", f"WITH {STATE} SELECT id FROM st WHERE status = 'active' AND list_contains(tags, 'kind:task') AND id NOT IN (SELECT conv_id * 2 FROM conversations) AND (id % 4 != 0 OR updated > DATE '2024-06-01') ORDER BY updated DESC, id LIMIT 60")
def unorganized(spark, sf_dir):
    rows = memory_state(spark, sf_dir)
    organized = rows.where("id % 4 = 0").select(F.col("id").alias("memory_id"), F.lit("2024-06-01").cast("date").alias("source_updated_at"))
    linked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 2).alias("memory_id"))
    return M.unorganized(rows, organized, linked).select("id")


@query("debounced", "SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 3 HOUR")
def debounced(spark, sf_dir):
    return M.debounced(table(spark, sf_dir, "events"), ["user_id", "event_type"], 3 * 3600).select("event_id")


# loops


@query("loop_starts", """WITH r AS (SELECT event_id AS place, user_id AS key, user_id % 2 = 0 OR event_type != 'error' AS same, min(event_id) OVER (PARTITION BY user_id) AS first FROM events), f AS (SELECT *, max(CASE WHEN place = first THEN same::INT END) OVER (PARTITION BY key) = same::INT AS alike FROM r)
SELECT place, key, CASE WHEN place = first OR alike THEN first END AS run, CASE WHEN place = first THEN 'started' WHEN alike THEN 'replayed' ELSE 'conflict' END AS outcome FROM f""")
def loop_starts(spark, sf_dir):
    """A user as a key; odd users' errors are another request. Keys of the request stand in either order."""
    other = (F.col("user_id") % 2 == 1) & (F.col("event_type") == "error")
    request = F.when(other, F.lit('{"a":2}')).when(F.col("event_id") % 2 == 0, F.lit('{"a":1,"b":[1]}')).otherwise(F.lit('{"b": [1], "a": 1}'))
    return P.started(table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), F.col("user_id").alias("key"), request.alias("request")))


@query("loop_attempts", f"""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, value FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS passed FROM e)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, passed ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM i""")
def loop_attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"), F.lit("x").alias("signature"), F.col("value").alias("tokens"))
    return P.attempts(events, "user_id", ["ts", "event_id"]).select("event_id", "iteration", "failures")


@query("loop_checkpoints")
def loop_checkpoints(spark, sf_dir):
    """A user's events as checkpoint writes of three workers, each expecting the version of its place."""
    numbered = P.sequenced(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    writes = numbered.select("user_id", F.col("sequence").alias("place"), F.floor(F.col("sequence") / 2).alias("expected"), (F.col("event_id") % 3).alias("worker"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.lit(7200).alias("lease_seconds"))
    return P.checkpointed(writes, "user_id")


# packs and backups


@query("context_pack")
def context_pack(spark, sf_dir):
    """A pack for every document whose id is divisible by 50: its text hits, their replacements and relations, within a budget."""
    mem = memory_state(spark, sf_dir).select("id", "title", "content", "status", F.col("kind").alias("_k"), "layer", "hit_count", "updated").withColumn("kind", F.when(F.col("_k") == "fact", "project_fact").otherwise("raw_note"))
    found = Q.bm25_search(mem, mem.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("query")), 36)
    along = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(along)).where("rank <= 36").join(mem.where("status = 'active'"), "id")
    score = C.candidate_score(F.col("score") / 1000, F.col("kind"), F.col("layer"), F.col("hit_count"))
    candidates = best.select(F.col("query_id").alias("pack"), "id", score.alias("score"))
    superseders = mem.where("id % 9 = 0").select(F.col("id").alias("superseder"), (F.col("id") + 1).alias("superseded"))
    edges = mem.where("id % 4 = 0").select(F.col("id").alias("source"), (F.col("id") + 3).alias("target"), F.lit("relates_to").alias("type"), (F.col("id") % 10 / 10).alias("strength"))
    grown = C.expanded(C.promoted(candidates, superseders, mem), G.related(edges), mem)
    grown = grown.join(superseders.select(F.col("superseded").alias("id")), "id", "left_anti").join(mem.select("id", "title", "content", "updated"), "id")
    return C.packed(grown).select("pack", "place", "id", F.length("content").alias("n"))


@query("table_fingerprint", "SELECT count(*) AS rows FROM orders")
def table_fingerprint(spark, sf_dir):
    """Rows of the fingerprint; equal tables in another order have the same one, which the tests check."""
    return backup.fingerprint(table(spark, sf_dir, "orders")).select("rows")


@query("keepers_tags", "SELECT p_brand AS keeper, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1")
def keepers_tags(spark, sf_dir):
    groups = table(spark, sf_dir, "part").select(F.col("p_brand").alias("keeper"), F.split("p_name", " ").alias("tags"))
    return D.merged_tags(groups).select("keeper", F.array_join("tags", ",").alias("tags"))


@query("parent_threads", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def parent_threads(spark, sf_dir):
    """The latest message of each thread: one row for a scalar subquery's ordered limit."""
    return R.top_per_key(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], [F.desc("turn")], 1).select("conv_id", "turn")


@query("offloaded", f"WITH {MEM} SELECT id, strlen(content) AS bytes, CASE WHEN strlen(content) > 4000 THEN sha256(content) END AS ref FROM mem WHERE content IS NOT NULL")
def offloaded(spark, sf_dir):
    rows = memories(spark, sf_dir).where("content IS NOT NULL").select("id", "content")
    return backup.offloaded(rows).select("id", F.col("bytes").cast("long").alias("bytes"), "ref")
