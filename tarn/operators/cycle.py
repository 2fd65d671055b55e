"""Steps of the upkeep cycle: conflicts, themes, journals, routing, self-checks, reasoning, writes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import rules as R
from tarn.functions.entities import entities
from tarn.functions.text import SECRET_RULES, error_signature, masked_secrets, secret_marks, without_secrets
from tarn.functions.vectors import cosine
from tarn.lineage import cut, kept, small_batches

# fixed values: a self-check's weights and its two thresholds
CHECK_WEIGHTS, RECORD, SUGGEST = (0.3, 0.3, 0.2, 0.1, 0.1), 0.75, 0.60
METHOD_WORDS = ["方法论", "原则", "规则", "经验", "教训", "最佳实践", "策略", "框架", "模式", "methodology", "principle", "rule", "lesson", "best practice"]
DECISION_WORDS = ["决定", "选择", "因为", "所以", "原因", "结论", "decided", "because", "therefore", "conclusion"]
REUSE_WORDS = ["配置", "模板", "脚本", "命令", "步骤", "流程", "config", "template", "script", "command", "step", "workflow"]
# fixed values: what keeps a memory private, and what makes it global
SENSITIVE = "(?i)password|secret|api[_-]?key|token|credential|密码|密钥|令牌|凭证"
GLOBAL = "偏好|配置|方法论|原则|规则|preference|config|methodology|principle|rule"


# conflicts


def conflicts(memories: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """entity_id, positive, negative: for each entity the first pair of memories that say opposite things of one topic.

    Only memories with a word of a pair of opposites are paired, on the entity. memories:
    id, title, content; links: entity_id, id; names: entity_id, name. A pair's positive
    side comes first by its place among the opposites, then by the ids.
    """
    fine = names.where((F.length(F.trim("name")) >= 2) & ~F.trim("name").rlike(R.NOISY_ENTITY))
    marks = []
    for k, (yes, no) in enumerate(R.OPPOSITES):
        says_no = R.has_any(F.col("content"), no)
        marks += [F.when(R.has_any(F.col("content"), yes) & ~says_no, F.struct(F.lit(k).alias("k"), F.lit(True).alias("positive"))), F.when(says_no, F.struct(F.lit(k).alias("k"), F.lit(False).alias("positive")))]
    said = memories.withColumn("m", F.explode(F.array_compact(F.array(*marks)))).join(links.distinct(), "id").join(fine, "entity_id")
    text = F.concat_ws(" ", "title", "content")
    side = lambda p, name: said.where(F.col("m.positive") == p).select("entity_id", F.col("m.k").alias("k"), F.col("id").alias(name), F.col("name").alias(f"_n_{name}"), text.alias(f"_t_{name}"))
    pairs = side(True, "positive").join(side(False, "negative"), ["entity_id", "k"]).where("positive != negative")
    met = pairs.where(R.shares_topic(F.col("_t_positive"), F.col("_t_negative"), F.col("_n_positive")))
    first = met.groupBy("entity_id").agg(F.min(F.struct("k", "positive", "negative")).alias("f"))
    return first.select("entity_id", "f.positive", "f.negative")


def divergent(memories: DataFrame, links: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """entity_id, one, two: at most so many pairs of an entity's memories that both speak of a change and share a topic."""
    fine = names.where((F.length(F.trim("name")) >= 2) & ~F.trim("name").rlike(R.NOISY_ENTITY))
    said = memories.where(R.has_any(F.col("content"), R.DIVERGENCE)).join(links.distinct(), "id").join(fine, "entity_id").withColumn("_t", F.concat_ws(" ", "title", "content"))
    one, two = said.select("entity_id", "name", F.col("id").alias("one"), F.col("_t").alias("_a")), said.select("entity_id", F.col("id").alias("two"), F.col("_t").alias("_b"))
    met = one.join(two, "entity_id").where("one < two").where(R.shares_topic(F.col("_a"), F.col("_b"), F.col("name")))
    ranked = met.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy("one", "two"))).where(F.col("_r") <= most)
    return ranked.select("entity_id", "one", "two")


# themes


def hot_tags(memories: DataFrame, most: int = 15) -> DataFrame:
    """tag, n: the tags that at least two memories have, the commonest first."""
    counted = memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 2")
    return counted.orderBy(F.desc("n"), "tag").limit(most)


def with_missing_tags(memories: DataFrame, hot: DataFrame, most: int = 3) -> DataFrame:
    """id, added: the hot tags that a memory's text names but it lacks, at most so many. hot is a top list, so it is broadcast."""
    themes = hot.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda x: x["tag"]).alias("themes"))
    low = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    text = F.lower(F.concat_ws("\n", "title", "content"))
    rows = memories.join(F.broadcast(themes))
    missing = F.filter("themes", lambda t: ~F.array_contains(low, F.lower(t)) & F.contains(text, F.lower(t)))
    return rows.select("id", F.slice(missing, 1, most).alias("added")).where(F.size("added") > 0)


def theme_relations(memories: DataFrame, hot: DataFrame, each: int = 8, most: int = 40) -> DataFrame:
    """source, target, tag: the first memories of each hot tag among themselves, so many of a tag and so many in all."""
    kept = hot.where(~F.lower("tag").rlike("^(kind|scope|project|sensitivity):"))
    held = memories.select("id", F.explode("tags").alias("tag")).distinct().join(F.broadcast(kept), "tag")
    first = held.withColumn("_r", F.row_number().over(Window.partitionBy("tag").orderBy("id"))).where(F.col("_r") <= each)
    one, two = first.select("tag", "n", F.col("id").alias("source"), F.col("_r").alias("_a")), first.select("tag", F.col("id").alias("target"), F.col("_r").alias("_b"))
    pairs = one.join(two, "tag").where("_a < _b").orderBy(F.desc("n"), "tag", "_a", "_b").limit(most)
    return pairs.select("source", "target", "tag")


# journals


def journals_due(memories: DataFrame, injections: DataFrame, since: Column, most: int = 10) -> DataFrame:
    """project, last_activity, memories: projects that were active since then, without a journal and without an open injection; the latest first."""
    active = memories.where("status = 'active'")
    kept = active.where(F.col("updated") >= since).groupBy("project").agg(F.max("updated").alias("last_activity"), F.count("*").alias("memories"))
    journal = active.where(F.exists("tags", lambda t: F.contains(t, F.lit("kind:project_journal")))).select("project").distinct()
    open_ = injections.where(F.col("status").isin("pending", "injected")).select("project").distinct()
    return kept.join(journal, "project", "left_anti").join(open_, "project", "left_anti").orderBy(F.desc("last_activity"), "project").limit(most)


# routing


def routed(memories: DataFrame, rules: DataFrame, mode: str, private: str) -> DataFrame:
    """id, space, confidence, confirm: where a new memory belongs. memories: id, content, layer.

    rules: pattern, kind (keyword or regex), space, priority: a settings table, read whole.
    The first that fits by priority counts; private stands for the agent's own space.
    """
    own = F.lit(private)
    text = F.col("content")
    struct = lambda s, c, ask=False: F.struct((s if isinstance(s, Column) else F.lit(s)).alias("space"), F.lit(c).alias("confidence"), F.lit(ask).alias("confirm"))
    if mode in ("isolated", "shared"):
        where = struct(own if mode == "isolated" else "global", 1.0)
    else:
        where = F
        for r in rules.orderBy(F.desc("priority"), "pattern").collect():
            fits = F.contains(F.lower(text), F.lit(r["pattern"].lower())) if r["kind"] == "keyword" else text.rlike(f"(?i){r['pattern']}")
            where = where.when(fits, struct(own if r["space"] == "private" else r["space"], 1.0))
        project = F.regexp_extract(text, "\\[\\[([^\\]]+)\\]\\]", 1)
        where = (
            where.when(text.rlike(SENSITIVE), struct(own, 1.0)).when(F.col("layer").isin("long", "entity"), struct("global", 0.9)).when(text.rlike(GLOBAL), struct("global", 0.85))
            .when(project != "", struct(F.concat(F.lit("project:"), project), 0.9)).otherwise(struct(own, 0.7 if mode in ("hybrid", "project") else 0.5, True))
        )
    return memories.select("id", where.alias("w")).select("id", "w.space", "w.confidence", "w.confirm")


def visible_spaces(agent: str, mode: str | None = None, user: str | None = None) -> list[str]:
    own = f"user:{user}:agent:{agent}" if user else f"agent:{agent}"
    return [own] if mode == "isolated" else ["global", own]


# self-checks


def self_checked(texts: DataFrame, recent: DataFrame, own_project: DataFrame, emphasis: Column) -> DataFrame:
    """id, total, action of new texts (id, content, vec). recent: the 20 newest vectors; own_project: ten of the project's (both bounded, broadcast)."""
    best = lambda df, n: df.limit(n).agg(F.collect_list("vec").alias("vs"))
    rows = texts.join(F.broadcast(best(recent, 20).withColumnRenamed("vs", "_recent"))).join(F.broadcast(best(own_project, 10).withColumnRenamed("vs", "_project")))
    nearest = lambda c: F.greatest(F.lit(0.0), F.array_max(F.transform(c, lambda v: cosine(v, F.col("vec")))))
    low = F.lower("content")
    relevance = F.when(F.size("_project") == 0, 0.5).otherwise(F.least(F.lit(1.0), nearest("_project") + 0.2))
    novelty = F.when(F.size("_recent") == 0, 0.8).otherwise(F.greatest(F.lit(0.1), 1 - nearest("_recent")))
    has = lambda words, x: F.when(R.has_any(low, words), x).otherwise(0.0)
    value = F.least(F.lit(1.0), 0.3 + has(METHOD_WORDS, 0.15) + has(DECISION_WORDS, 0.15) + F.when(F.length("content") > 200, 0.1).otherwise(0.0))
    parts = (relevance, value, novelty, emphasis, F.least(F.lit(1.0), 0.3 + has(REUSE_WORDS, 0.2)))
    total = reduce(Column.__add__, [w * p for w, p in zip(CHECK_WEIGHTS, parts, strict=True)])
    return rows.select("id", total.alias("total")).withColumn("action", F.when(F.col("total") > RECORD, "auto_record").when(F.col("total") > SUGGEST, "suggest").otherwise("ignore"))


# reasoning


def unscanned(memories: DataFrame, log: DataFrame, most: int = 8) -> DataFrame:
    """The active memories that relation reasoning has not seen: the latest hit first, those never hit last."""
    rows = memories.where("status = 'active'").join(log.select("id").distinct(), "id", "left_anti")
    return rows.orderBy(F.desc_nulls_last("last_hit_at"), F.desc("created"), "id").limit(most)


def older_candidates(anchors: DataFrame, memories: DataFrame, each: int = 500, block: int = 4096) -> DataFrame:
    """anchor, id: active memories of the anchor's space that are older than it, by (created, id); each anchor's latest hit first.

    Memories in order of age are cut into blocks. Over the blocks stands a binary tree
    whose nodes hold the first rows of each space below them. What is older than an
    anchor is a node for each bit of its block's number, and the part of its own block
    before it; no space is joined with itself.
    """
    rows = memories.where("status = 'active'").select("id", "agent_space", "last_hit_at", "updated", "created", F.lit(False).alias("_anchor"))
    asked = anchors.select("id", "agent_space", F.lit(None).cast(rows.schema["last_hit_at"].dataType).alias("last_hit_at"), F.lit(None).cast(rows.schema["updated"].dataType).alias("updated"), "created", F.lit(True).alias("_anchor"))
    both = rows.unionByName(asked)
    parts = max(1, -(-both.count() // block))
    dealt = kept(both.repartitionByRange(parts, "created", "id").withColumn("block", F.spark_partition_id()), "dealt")
    own, asked = dealt.where("NOT _anchor").drop("_anchor"), dealt.where("_anchor").select(F.col("id").alias("anchor"), "agent_space", "block", F.struct("created", "id").alias("_at"))
    order = [F.desc_nulls_last("last_hit_at"), F.desc("updated"), "id"]

    def first(found: DataFrame, *keys: str) -> DataFrame:
        return found.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= each).drop("_r")

    node, names = own.withColumn("node", F.col("block")), ["agent_space", "node", "id", "last_hit_at", "updated"]
    tree, level = None, 0
    while (parts - 1) >> level:
        node = kept(first(node.select(*names), "agent_space", "node"), "nodes")
        tree = node.withColumn("level", F.lit(level)) if tree is None else tree.unionByName(node.withColumn("level", F.lit(level)))
        node, level = node.withColumn("node", F.shiftright("node", 1)), level + 1
    inside = asked.join(own.select("agent_space", "block", "id", "last_hit_at", "updated", F.struct("created", "id").alias("_then")), ["agent_space", "block"]).where(F.col("_then") < F.col("_at"))
    found = inside.select("anchor", "id", "last_hit_at", "updated")
    if tree is not None:
        bits = F.filter(F.sequence(F.lit(0), F.lit(level - 1)), lambda k: F.call_function("shiftright", F.col("block"), k) % 2 == 1)
        before = asked.select("anchor", "agent_space", "block", F.explode(bits).alias("level")).withColumn("node", F.expr("shiftright(block, level) - 1"))
        found = found.unionByName(before.join(tree, ["agent_space", "level", "node"]).select("anchor", "id", "last_hit_at", "updated"))
    return first(found, "anchor").select("anchor", "id")


def accepted_judgments(judgments: DataFrame, memories: DataFrame) -> DataFrame:
    """Judged relations that hold up: strength from 0.5 to 1, a quote that the target's text has, two targets at least for a bridge."""
    rows = judgments.join(memories.select(F.col("id").alias("target"), "content"), "target").where(F.col("strength").between(0.5, 1) & (F.length(F.trim("quote")) > 0) & F.contains("content", F.col("quote")))
    bridges = rows.where("type = 'bridges'").groupBy("source").agg(F.countDistinct("target").alias("_n")).where("_n >= 2").select("source")
    fine = rows.where("type != 'bridges'").unionByName(rows.where("type = 'bridges'").join(bridges, "source", "left_semi").select(*rows.columns))
    return fine.select("source", "target", "type", "strength")


# writes


def created(incoming: DataFrame) -> dict[str, DataFrame]:
    """What new memories (id, title, content, tags, layer) add to each table: memories, versions, entities, links, postings.

    Titles lose their marks, secrets are masked, tags are normalized, missing layers inferred.
    """
    clean = without_secrets(without_secrets(incoming.withColumn("title", R.stripped_title(F.col("title"))), "title", "_t"), "content", "_c")
    masked = (F.size("_t") > 0) | (F.size("_c") > 0)
    tags = R.normalized_tags(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.when(masked, F.array(F.lit("sensitivity:redacted"))).otherwise(F.array().cast("array<string>"))))
    none = F.lit(None).cast("string")
    layer = F.coalesce("layer", R.memory_layer(F.col("title"), F.col("content"), none, none, F.lit(None).cast("double")))
    rows = clean.select("id", "title", "content", tags.alias("tags"), layer.alias("layer"))
    found = entities(rows)
    return {
        "memories": rows,
        "versions": rows.select("id", F.lit(1).cast("long").alias("version"), "content", F.lit("create").alias("change_type")),
        "entities": found.groupBy("name").agg(F.max_by("type", F.struct("confidence", "type")).alias("type")),
        "links": found.select("id", "name").distinct(),
        "postings": postings(rows),
    }


def _grams(batches):
    """row, gram, tf: the trigrams of each text, some texts at a time."""
    for batch in (x.slice(k, 256) for x in batches for k in range(0, len(x), 256)):
        texts = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in batch.column("low").to_pylist()]
        keys = np.concatenate([t[:-2] << 42 | t[1:-1] << 21 | t[2:] for t in texts])
        row = np.repeat(np.arange(len(texts)), [len(t) - 2 for t in texts])
        names, which = np.unique(keys, return_inverse=True)
        pairs, tf = np.unique(row * len(names) + which, return_counts=True)
        code = np.stack([names >> 42, names >> 21 & 0x1FFFFF, names & 0x1FFFFF], axis=1).astype("<u4")
        grams = pa.array([x.tobytes().decode("utf-32-le") for x in code], pa.string())
        for k in range(0, len(pairs), 1 << 16):
            own = pairs[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own // len(names))), grams.take(pa.array(own % len(names))), pa.array(tf[k : k + (1 << 16)])], names=["id", "gram", "tf"])


def postings(memories: DataFrame) -> DataFrame:
    """id, gram, tf: the trigrams of each memory's text, for the index. A text's are counted where it lies; only those of ids in several rows are added up."""
    small_batches(memories.sparkSession)
    low = F.lower(F.concat_ws(" ", "title", "content", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    rows = memories.select("id", low.alias("low")).where(F.length("low") >= 3)
    several = memories.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1 OR id IS NULL").select(F.col("id").alias("_id"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    counted = lambda own: own.mapInArrow(_grams, f"id {memories.schema['id'].dataType.simpleString()}, gram string, tf long")
    return counted(rows.join(several, same, "left_anti")).unionByName(counted(rows.join(several, same, "left_semi")).groupBy("id", "gram").agg(F.sum("tf").alias("tf")))


def batch_outcome(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """place, id, ok, reason of a batch's updates: an unknown or repeated id fails, the rest go on."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("place")) == 1
    rows = requests.withColumn("_first", first).join(memories.select("id", F.lit(True).alias("_there")), "id", "left")
    reason = F.when(F.col("_there").isNull(), "not found").when(~F.col("_first"), "repeated")
    return rows.select("place", "id", reason.isNull().alias("ok"), reason.alias("reason"))


def query_log(ranked: DataFrame, queries: DataFrame, latency_ms: int, degraded: str | None = None) -> DataFrame:
    """Rows for the query log: the query without its secrets, cut at 200 characters, each hit's rank and score, how many candidates there were."""
    safe = without_secrets(queries, "query", "_f").select("query_id", F.substring("query", 1, 200).alias("query"))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    return ranked.join(safe, "query_id").join(counts, "query_id").select("query_id", "query", "id", "rank", "score", F.lit(latency_ms).alias("latency_ms"), "candidate_count", F.lit(degraded).cast("string").alias("degraded_reason"))


def with_feedback(memories: DataFrame, votes: DataFrame) -> DataFrame:
    """memories after votes (id, place, up), each 0.02 more or 0.05 less confidence, from 0.1 to 1, one after the other."""
    ordered = votes.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "up"))), lambda v: v["up"]).alias("_votes"))
    step = lambda c, up: F.least(F.lit(1.0), F.greatest(F.lit(0.1), c + F.when(up, 0.02).otherwise(-0.05)))
    rows = memories.join(ordered, "id", "left")
    return rows.withColumn("confidence", F.when(F.col("_votes").isNotNull(), F.aggregate("_votes", F.col("confidence").cast("double"), step)).otherwise(F.col("confidence"))).select(*memories.columns)


# further rules


def iso_time(text: Column) -> Column:
    """A timestamp out of an ISO 8601 text, or null."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def valid_window(start: Column, end: Column) -> Column:
    """Whether a window is one: a valid start, and an end that is missing or later."""
    a, b = iso_time(start), iso_time(end)
    return F.coalesce(a.isNotNull() & (end.isNull() | (b > a)), F.lit(False))


def neighbourhood(rows: DataFrame, order: list[Column], n: int = 19) -> DataFrame:
    """one, two: each row with the n after it in the order. rows: id.

    Rows are numbered by ranges of the order, not by one task, and meet by number.
    """
    numbered = _numbered(rows, order)
    ahead = numbered.select(F.col("id").alias("two"), F.explode(F.when(F.col("k") > 0, F.sequence(F.greatest(F.lit(0), F.col("k") - n), F.col("k") - 1))).alias("k"))
    return numbered.select(F.col("id").alias("one"), "k").join(ahead, "k").select("one", "two")


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with k, from 0 in the order: ranges are counted, and numbered each by itself."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each range
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_i", inner).join(F.broadcast(before), "_part").withColumn("k", F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def redacted_json(rows: DataFrame, json: str, findings: str) -> DataFrame:
    """rows with the secrets in a JSON column's strings masked, and the findings by type; malformed JSON becomes null.

    Each string value is masked by itself, at any depth: the text between two quotes that
    no colon follows. Keys stay. Only strings with a mark of a secret are touched.
    """
    own = rows.withColumn(json, F.when(F.try_parse_json(json).isNotNull(), F.col(json)))
    token = '"(?:[^"\\\\]|\\\\.)*"(?:\\s*:)?|[^"]+'
    marks = secret_marks([(some, pattern) for _, some, pattern, _ in SECRET_RULES])

    def part(p: Column) -> Column:
        value = p.rlike('(?s)^".*"$') & p.rlike(marks)
        inside = F.transform(F.array(masked_secrets(F.substring(p, F.lit(2), F.length(p) - 2))), lambda m: F.struct(F.concat(F.lit('"'), m["text"], F.lit('"')).alias("text"), m["n"].alias("n")))
        return F.when(value, F.element_at(inside, 1)).otherwise(F.struct(p.alias("text"), F.array().cast("array<int>").alias("n")))

    clean = own.withColumn("_parts", F.transform(F.regexp_extract_all(json, F.lit(token), F.lit(0)), part))
    times = lambda i: F.aggregate("_parts", F.lit(0), lambda acc, x: acc + F.coalesce(F.get(x["n"], F.lit(i)), F.lit(0)))
    counts = F.map_filter(F.create_map(*[x for i, (kind, *_) in enumerate(SECRET_RULES) for x in (F.lit(kind), times(i))]), lambda _, n: n > 0)
    text = F.array_join(F.transform("_parts", lambda x: x["text"]), "")
    return clean.select(*[text.alias(c) if c == json else F.col(c) for c in rows.columns], F.when(F.col("_parts").isNotNull(), counts).alias(findings))


def best_projects(memories: DataFrame, aliases: DataFrame, shared: DataFrame) -> DataFrame:
    """id, project, score: the project that a memory without one fits best.

    A name of the project in the text counts its length, in a tag eight more, shared
    entities five each and up to ten for their share; the greatest counts. aliases: project,
    alias (a settings table, broadcast by the block); shared: id, project, overlap, own.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("\n", "title", "content", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\n"))), "[_\\-]+", " "), "\\s+", " ")
    low_tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    rows = memories.select("id", plain.alias("_text"), low_tags.alias("_tags"))
    named = rows.join(F.broadcast(aliases.where(R.specific_project(F.col("alias")))), F.contains("_text", F.col("alias")))
    tagged = F.exists("_tags", lambda t: F.contains(t, F.col("alias")) | F.contains(F.col("alias"), t))
    by_name = named.select("id", "project", (F.length("alias") + F.when(tagged, 8).otherwise(0)).alias("score"))
    by_entity = shared.where("overlap > 0").select("id", "project", (F.col("overlap") * 5 + F.floor(F.col("overlap") / F.col("own") * 10)).cast("int").alias("score"))
    best = by_name.unionByName(by_entity).groupBy("id", "project").agg(F.max("score").alias("score"))
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "project"))).where("_r = 1").drop("_r")


def conflict_resolved(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """memories after decisions (memory, target, action) on conflicts: keep_memory and keep_target archive the other side, merge_into_* too, delete_* removes a side."""
    side = lambda c, actions, what: decisions.where(F.col("action").isin(*actions)).select(F.col(c).alias("id"), F.lit(what).alias("_do"))
    done = side("target", ("keep_memory", "merge_into_memory"), "archived").unionByName(side("memory", ("keep_target", "merge_into_target"), "archived"))
    done = done.unionByName(side("memory", ("delete_memory",), "deleted")).unionByName(side("target", ("delete_target",), "deleted")).groupBy("id").agg(F.max("_do").alias("_do"))
    return memories.join(done, "id", "left").withColumn("status", F.coalesce("_do", "status")).select(*memories.columns)


def moved_layer(memories: DataFrame, moves: DataFrame, layers: tuple[str, ...] = ("flash", "short", "long", "entity")) -> DataFrame:
    """memories after moves (id, layer); an unknown layer moves nothing."""
    new = moves.where(F.col("layer").isin(*layers)).groupBy("id").agg(F.max("layer").alias("_new"))
    return memories.join(new, "id", "left").withColumn("layer", F.coalesce("_new", "layer")).select(*memories.columns)


def stripped_prefix(text: Column) -> Column:
    """A bulk import's title without its bracket, its word before a colon or dash (addresses stay) and its migration mark."""
    word = "[\\w\\u4e00-\\u9fff]+"
    text = F.regexp_replace(text, f"^\\[{word}\\]\\s*", "")
    text = F.when(text.rlike("(?i)^(http|https|ftp|www)"), text).otherwise(F.regexp_replace(text, f"^{word}[:：-]\\s*", ""))
    return F.regexp_replace(F.regexp_replace(text, "(?i)^migration[:：\\s]*\\S*\\s*", ""), "^\\s+", "")


def finished(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """runs after ends (run, status, tokens, error): completed, failed or cancelled, with the tokens added and a failure's signature; other statuses and finished runs change nothing."""
    fine = ends.where(F.col("status").isin("completed", "failed", "cancelled")).groupBy("run").agg(F.min(F.struct("place", "status", "tokens", "error")).alias("_e"))
    rows = runs.join(fine, "run", "left")
    open_ = F.col("_e").isNotNull() & (F.col("status") == "running")
    return rows.select(
        "run", F.when(open_, F.col("_e.status")).otherwise(F.col("status")).alias("status"), (F.col("token_used") + F.when(open_, F.greatest(F.lit(0), F.col("_e.tokens"))).otherwise(0)).alias("token_used"),
        F.when(open_ & (F.col("_e.status") == "failed"), error_signature(F.col("_e.error"))).otherwise(F.col("last_error_signature")).alias("last_error_signature"),
    )


def admitted(checked: DataFrame, texts: DataFrame) -> DataFrame:
    """id, decision, confidence of new texts (id, content) by their self-check (id, total, action): worthless ones are refused, the rest recorded, suggested or left."""
    value = R.value_of(F.col("content"))["verdict"]
    confidence = F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.95), 0.55 + F.col("total") * 0.4)), 3)
    return checked.join(texts, "id").select("id", F.when(value == "reject", "refused").otherwise(F.col("action")).alias("decision"), confidence.alias("confidence"))


def retyped_projects(memories: DataFrame, projects: DataFrame) -> DataFrame:
    """A migration's step: projects by name become ids; names that no project has become null."""
    first = projects.groupBy(F.col("name").alias("project")).agg(F.min("id").alias("project_id"))
    return memories.join(first, "project", "left").drop("project")


def context_fingerprint(parts: Column) -> Column:
    """Of a context's JSON parts, in their order, whatever the order of the keys within."""
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.coalesce(R.canonical_json(p), F.lit("null"))), "\n"), 256)


def autonomy(score: Column) -> Column:
    """What a cycle may do by itself: apply from 0.85 on, note from 0.72 on, else ask."""
    return F.when(score >= 0.85, "apply").when(score >= 0.72, "note").otherwise("ask")


def accepted_merge(original: Column, merged: Column) -> Column:
    """Whether a refined text may stand for its originals: another text, from three tenths to six fifths of their length."""
    share = F.length(merged) / F.greatest(F.lit(1), F.length(original))
    return F.coalesce((merged != original) & share.between(0.3, 1.2), F.lit(False))


def evidence(parts: DataFrame, caps: dict[str, int], total: int = 60_000) -> DataFrame:
    """thread_id, place, kind, chars: a thread's parts in order, each cut at its kind's cap, until the total is reached."""
    cap = reduce(lambda out, k: out.when(F.col("kind") == k, caps[k]), caps, F).otherwise(min(caps.values()))
    rows = parts.withColumn("chars", F.least(F.length("text"), cap))
    so_far = F.sum("chars").over(Window.partitionBy("thread_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", so_far).where(F.col("_sum") <= total).select("thread_id", "place", "kind", "chars")


def checked_references(runs: DataFrame, memories: DataFrame, spaces: DataFrame) -> DataFrame:
    """run, ok: whether all memories that a run refers to are there and in a space that it sees. runs: run, memory_refs; spaces: run, space; memories: id, agent_space."""
    refs = runs.select("run", F.explode(F.array_distinct("memory_refs")).alias("id"))
    seen = refs.join(memories, "id").join(spaces.withColumnRenamed("space", "agent_space"), ["run", "agent_space"], "left_semi").groupBy("run").agg(F.countDistinct("id").alias("_n"))
    return runs.join(seen, "run", "left").select("run", (F.coalesce("_n", F.lit(0)) == F.size(F.array_distinct("memory_refs"))).alias("ok"))


def relinked(links: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """thread_id, memory_id after links were added and others taken away."""
    keys = ["thread_id", "memory_id"]
    return links.select(*keys).unionByName(added.select(*keys)).distinct().join(removed.select(*keys).distinct(), keys, "left_anti")
