"""The life of a memory: versions, decay, forgetting, restoring, superseding, quality, promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import rules as R

# fixed values: by layer, the idle days after which it decays, and the factor
DECAY = {"flash": (14, 0.95), "short": (60, 0.98), "long": (180, 0.99)}
FLOOR, RESET = 0.01, 0.5
DEMOTE_LONG, DEMOTE_SHORT = (0.3, 90), (0.2, 30)  # below this decay, and idle for so many days
# fixed values: weights of relevance, frequency, query diversity, recency, consolidation, conceptual richness
DREAM_WEIGHTS = (0.30, 0.24, 0.15, 0.15, 0.10, 0.06)
OPERATIONAL = ("kind:", "scope:", "project:", "sensitivity:")


def _idle(now: Column, days) -> Column:
    """Never hit, or not for so many days."""
    return F.col("last_hit_at").isNull() | (F.col("last_hit_at") <= F.date_sub(now, days))


def decayed(memories: DataFrame, now: Column) -> DataFrame:
    """memories after a decay pass: layer, confidence, decay_factor and status as they become.

    Steps follow one another, each on what the one before left: idle active memories lose
    by their layer's factor; long ones that fell low go to short, with a fresh factor;
    short ones that fell low go to flash; what has nothing left is decayed.
    """
    due = reduce(lambda out, x: out.when((F.col("layer") == x) & _idle(now, DECAY[x][0]), DECAY[x][1]), DECAY, F).otherwise(1.0)
    rate = F.when((F.col("status") == "active") & (F.col("decay_factor") > FLOOR), due).otherwise(1.0)
    rows = memories.withColumn("_rate", rate)
    rows = rows.withColumns({
        "decay_factor": F.col("decay_factor") * F.col("_rate"),
        "confidence": F.when(F.col("_rate") < 1, F.greatest(F.lit(0.1), F.col("confidence") * F.col("_rate"))).otherwise(F.col("confidence")),
    }).drop("_rate")
    low = lambda layer, rule: (F.col("status") == "active") & (F.col("layer") == layer) & (F.col("decay_factor") < rule[0]) & _idle(now, rule[1])
    rows = rows.withColumn("_down", low("long", DEMOTE_LONG))
    rows = rows.withColumns({"layer": F.when(F.col("_down"), "short").otherwise(F.col("layer")), "decay_factor": F.when(F.col("_down"), RESET).otherwise(F.col("decay_factor"))}).drop("_down")
    rows = rows.withColumn("layer", F.when(low("short", DEMOTE_SHORT), "flash").otherwise(F.col("layer")))
    return rows.withColumn("status", F.when((F.col("status") == "active") & (F.col("decay_factor") <= FLOOR), "decayed").otherwise(F.col("status")))


def forgotten(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """memories after requests (id, method): archive keeps the row, decay empties its worth, delete removes it."""
    rows = memories.join(requests.groupBy("id").agg(F.max_by("method", F.when(F.col("method") == "delete", 3).when(F.col("method") == "decay", 2).otherwise(1)).alias("method")), "id", "left")
    gone = F.col("method") == "decay"
    return rows.where(F.coalesce(F.col("method") != "delete", F.lit(True))).withColumns({
        "status": F.when(F.col("method") == "archive", "archived").when(gone, "decayed").otherwise(F.col("status")),
        "confidence": F.when(gone, 0.0).otherwise(F.col("confidence")),
        "decay_factor": F.when(gone, 0.0).otherwise(F.col("decay_factor")),
    }).select(*memories.columns)


def restored(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """memories with the named archived or decayed ones active again, at full worth."""
    back = F.col("_back") & F.col("status").isin("archived", "decayed")
    rows = memories.join(ids.select("id", F.lit(True).alias("_back")).distinct(), "id", "left").withColumn("_back", F.coalesce(back, F.lit(False)))
    return rows.withColumns({
        "status": F.when(F.col("_back"), "active").otherwise(F.col("status")),
        "confidence": F.when(F.col("_back"), 1.0).otherwise(F.col("confidence")),
        "decay_factor": F.when(F.col("_back"), 1.0).otherwise(F.col("decay_factor")),
    }).select(*memories.columns)


def recycle_bin(memories: DataFrame, statuses: tuple[str, ...] = ("archived", "decayed", "deleted")) -> DataFrame:
    return memories.where(F.col("status").isin(*statuses))


def patched(memories: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """memories with a patch's values where it has any; metadata is merged key by key, null deleting a key. patches: one row per id."""
    named = patches.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = memories.join(named, "id", "left")
    merged = {c: F.coalesce(f"_new_{c}", c) for c in columns if c != "metadata"}
    if "metadata" in columns:
        old, new = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in ("metadata", "_new_metadata"))
        both = F.map_filter(F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new), lambda _, v: v.isNotNull())
        merged["metadata"] = F.when(F.col("_new_metadata").isNotNull(), F.to_json(both)).otherwise(F.col("metadata"))
    return rows.withColumns(merged).select(*memories.columns)


def appended_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The version rows that changes (id, place, content, change_type) add, numbered on from each memory's count."""
    before = versions.groupBy("id").agg(F.count("*").alias("_had"))
    numbered = changes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("place"))).join(before, "id", "left")
    return numbered.select("id", (F.coalesce("_had", F.lit(0)) + F.col("_n")).cast("long").alias("version"), "content", "change_type")


def version_diff(versions: DataFrame) -> DataFrame:
    """id, version, line, before, after: the lines that a version changed, by their place."""
    along = Window.partitionBy("id").orderBy("version")
    pairs = versions.withColumn("previous", F.lag("content").over(along)).where("previous IS NOT NULL")
    lines = F.arrays_zip(F.split("previous", "\\n").alias("before"), F.split("content", "\\n").alias("after"))
    found = pairs.select("id", "version", F.posexplode(lines).alias("at", "x"))
    return found.where(~F.col("x.before").eqNullSafe(F.col("x.after"))).select("id", "version", (F.col("at") + 1).alias("line"), "x.before", "x.after")


def rolled_back(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The version rows that going back adds: the wanted version's content, as the next number. wanted: id, version."""
    content = versions.join(wanted, ["id", "version"]).select("id", F.lit(1).alias("place"), "content", F.lit("rollback").alias("change_type"))
    return appended_versions(versions, content)


def superseded(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """memories with valid_to closed where a newer one takes over (the earliest if several do). edges: source, target, effective_at.

    Edges to itself, to a memory that begins later, or of a memory that is not there are no edges.
    """
    known = edges.where("source != target").join(memories.select(F.col("id").alias("source")), "source", "left_semi")
    first = known.groupBy(F.col("target").alias("id")).agg(F.min("effective_at").alias("_closed"))
    rows = memories.join(first, "id", "left")
    closes = F.col("_closed").isNotNull() & (F.col("_closed") > F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_closed")))
    return rows.withColumn("valid_to", F.when(closes, F.col("_closed")).otherwise(F.col("valid_to"))).select(*memories.columns)


def strongest_superseder(edges: DataFrame, sources: DataFrame, moment: Column) -> DataFrame:
    """superseded, superseder: of the active sources valid at the moment, the strongest edge's, then the newest's, then the smallest id."""
    live = sources.where((F.col("status") == "active") & (F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))
    own = edges.join(live.select(F.col("id").alias("superseder")), "superseder", "left_semi")
    best = F.max(F.struct("strength", "created", (-F.col("superseder")).alias("superseder"))).alias("best")
    return own.groupBy("superseded").agg(best).select("superseded", (-F.col("best.superseder")).alias("superseder"))


def quality_issues(now: Column) -> Column:
    """What is wrong with a memory, of nine things. Columns: title, content, layer, project, confidence, decay_factor, updated, tags, source, kind."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    length = R.plain_length(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    age = F.greatest(F.lit(0), F.datediff(now, "updated"))
    domain = F.filter(tags, lambda t: ~reduce(Column.__or__, [F.startswith(F.lower(t), F.lit(p)) for p in OPERATIONAL]))
    homeless = F.col("project").isNull() & ~F.exists(tags, lambda t: F.startswith(t, F.lit("project:")) | (t == "scope:project")) & (F.col("layer") != "entity")
    found = {
        "sparse_content": length < 40,
        "missing_project": homeless,
        "missing_kind": F.col("kind").isNull() & ~F.exists(tags, lambda t: F.startswith(t, F.lit("kind:"))),
        "missing_source": F.col("source").isNull(),
        "missing_domain_tags": F.size(domain) == 0,
        "low_confidence": F.col("confidence") < 0.7,
        "decaying": F.col("decay_factor") < 0.5,
        "stale_flash": (F.col("layer") == "flash") & (age >= 7),
        "stale_short": (F.col("layer") == "short") & (age >= 30) & (F.col("decay_factor") < 0.8),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]), lambda x: x.isNotNull())


# fixed values: what each issue costs
PENALTY = {"sparse_content": 20, "missing_project": 12, "missing_kind": 10, "missing_source": 8, "missing_domain_tags": 8, "low_confidence": 14, "decaying": 10, "stale_flash": 10, "stale_short": 6}


def with_quality(memories: DataFrame, now: Column) -> DataFrame:
    """memories with issues, quality (0 to 100) and maturity (seed, usable, trusted)."""
    cost = F.create_map(*[x for k, v in PENALTY.items() for x in (F.lit(k), F.lit(v))])
    rows = memories.withColumn("issues", quality_issues(now))
    score = F.greatest(F.lit(0), 100 - F.aggregate("issues", F.lit(0), lambda acc, x: acc + F.element_at(cost, x)))
    return rows.withColumn("quality", score).withColumn("maturity", F.when(F.col("quality") >= 82, "trusted").when(F.col("quality") >= 62, "usable").otherwise("seed"))


def dream_scored(memories: DataFrame, queries: DataFrame, now: Column, lookback: int = 30) -> DataFrame:
    """Active flash, short and long memories of the lookback with unique_queries and score.

    Six signals, weighted, times 0.75 to 1 by quality. Without a log, six tenths of the hits
    count as queries, and one at least. queries: id, query.
    """
    asked = queries.groupBy("id").agg(F.countDistinct("query").alias("_asked"))
    rows = memories.where((F.col("status") == "active") & F.col("layer").isin("short", "long", "flash") & (F.col("created") >= F.date_sub(now, lookback)))
    rows = with_quality(rows, now).join(asked, "id", "left")
    unique = F.coalesce("_asked", F.greatest(F.lit(1), F.floor(F.col("hit_count") * 0.6 + 0.5)))
    one = F.lit(1.0)
    signals = (
        F.least(one, F.col("confidence")), F.least(one, F.col("hit_count") / 20), F.least(one, unique / 10), F.exp(-F.greatest(one, F.datediff(now, "created").cast("double")) / 30),
        F.when(F.col("hit_count") > 0, F.least(one, 1.5 - F.col("decay_factor"))).otherwise(0.0), F.least(one, F.size(F.coalesce("tags", F.array().cast("array<string>"))) / 5),
    )
    raw = reduce(Column.__add__, [w * s for w, s in zip(DREAM_WEIGHTS, signals, strict=True)])
    return rows.withColumns({"unique_queries": unique.cast("long"), "score": raw * (0.75 + F.col("quality") / 100 * 0.25)}).drop("_asked")


def promotion_ready(scored: DataFrame) -> DataFrame:
    """Of dream_scored(), the short and flash memories that may become long ones."""
    return scored.where("score >= 0.8 AND hit_count >= 3 AND unique_queries >= 3 AND layer IN ('short', 'flash') AND quality >= 65 AND NOT array_contains(issues, 'sparse_content')")


def fading(memories: DataFrame, now: Column) -> DataFrame:
    """Active memories that are losing worth, the least first, with the days since their last hit."""
    rows = memories.where("status = 'active' AND decay_factor < 1 AND decay_factor > 0.01")
    return rows.select("id", "layer", "decay_factor", F.datediff(now, "last_hit_at").alias("days_since_hit"))


def orphans(memories: DataFrame, entity_links: DataFrame, relations: DataFrame, threads: DataFrame) -> DataFrame:
    """Active memories beyond flash without entity, tag, relation or thread that nobody confirmed as standing alone."""
    rows = memories.where((F.col("status") == "active") & (F.col("layer") != "flash") & (F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0))
    rows = rows.where(F.coalesce(F.get_json_object("metadata", "$.associationStatus"), F.lit("")) != "independent")
    linked = entity_links.select(F.col("memory_id").alias("id"))
    for other in (relations.select(F.col("source").alias("id")), relations.select(F.col("target").alias("id")), threads.select(F.col("memory_id").alias("id"))):
        linked = linked.unionByName(other)
    return rows.join(linked.distinct(), "id", "left_anti")


def health(memories: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: the counts of a store's health, its five sub-scores and their mean.

    counts: one row with duplicates, orphans, conflicts, produced (by dreams) and loop_runs.
    """
    active = F.col("status") == "active"
    of = lambda layer: F.count_if(active & (F.col("layer") == layer))
    row = memories.agg(
        of("flash").alias("flash"), of("short").alias("short"), of("long").alias("long"), of("entity").alias("entity"),
        F.count_if(active & (F.col("decay_factor") < 1) & (F.col("decay_factor") > 0.01)).alias("decaying"),
        F.count_if(active & (F.col("layer") == "long") & (F.col("last_hit_at").isNull() | (F.col("hit_count") == 0))).alias("long_zero_hit"),
        F.count_if(active & F.exists("tags", lambda t: t == "sensitivity:redacted")).alias("redacted"),
    ).crossJoin(counts.limit(1))  # fmt: skip  # a row and a row
    ratio = F.when(F.col("long") > 0, F.col("long_zero_hit") / F.col("long")).otherwise(0.0)
    without = lambda c: (F.col(c) == 0).cast("int")
    penalty = 25 * without("short") + 10 * without("flash") + F.floor(ratio * 20 + 0.5) + 15 * without("produced") + 10 * without("loop_runs")
    less = lambda each, c: F.greatest(F.lit(0), 100 - each * F.col(c)).cast("long")
    parts = {"unique_score": less(5, "duplicates"), "linked_score": less(3, "orphans"), "agreed_score": less(10, "conflicts"), "fresh_score": less(2, "decaying"), "flow": F.greatest(F.lit(0), 100 - penalty).cast("long")}
    return row.withColumns(parts).withColumn("score", F.floor(reduce(Column.__add__, [F.col(c) for c in parts]) / 5 + 0.5).cast("long"))


def consolidation_plan(memories: DataFrame, duplicates: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """action, id: each memory's first of four actions, at most so many: deduplicate, archive_stale, archive_flash, solidify.

    duplicates: id of the memories that a keeper replaces.
    """
    rows = memories.where("status = 'active'").join(duplicates.select("id", F.lit(True).alias("_dup")).distinct(), "id", "left")
    action = (
        F.when(F.col("_dup"), "1 deduplicate")
        .when(F.col("layer").isin("short", "long") & (F.col("decay_factor") < 0.3) & _idle(now, 60), "2 archive_stale")
        .when((F.col("layer") == "flash") & (F.col("created") <= F.date_sub(now, 14)), "3 archive_flash")
        .when((F.col("layer") == "short") & (F.col("hit_count") >= 8), "4 solidify")
    )
    planned = rows.withColumn("_a", action).where("_a IS NOT NULL").orderBy("_a", "id").limit(most)
    return planned.select(F.substring("_a", 3, 20).alias("action"), "id")


def inspection(memories: DataFrame, orphan_ids: DataFrame, now: Column) -> DataFrame:
    """task, id of a daily inspection: flash memories of a week unsorted, short ones hit eight times, orphans."""
    active = memories.where("status = 'active'")
    old = active.where((F.col("layer") == "flash") & (F.col("created") <= F.date_sub(now, 7))).select(F.lit("archive").alias("task"), "id")
    hit = active.where("layer = 'short' AND hit_count >= 8").select(F.lit("solidify").alias("task"), "id")
    return old.unionByName(hit).unionByName(orphan_ids.select(F.lit("orphan").alias("task"), "id"))
