"""Filters over memories: source scope, kind, tags, entities, visibility, supersession, term fall-back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.relational import valid_at


def source_path(metadata: Column, project_path: Column) -> Column:
    """Where a memory comes from: its metadata's source path, the path of an old project, or its project's path. Malformed JSON has none."""
    fine = F.when(F.try_parse_json(metadata).isNotNull(), metadata)
    return F.coalesce(F.get_json_object(fine, "$.sourceProjectPath"), F.get_json_object(fine, "$.legacyProject.path"), project_path)


def in_scope(path: Column, scope: str, descendants: bool = True) -> Column:
    below = F.startswith(path, F.lit(f"{scope}/")) if descendants else F.lit(False)
    return F.coalesce((path == scope) | below, F.lit(False))


def memory_kind_of(metadata: Column, tags: Column, kinds: list[str]) -> Column:
    """A stored memory's kind: from its metadata, else from its first kind: tag, else raw_note."""
    own = F.get_json_object(F.when(F.try_parse_json(metadata).isNotNull(), metadata), "$.memoryKind")
    tag = F.regexp_replace(F.try_element_at(F.filter(tags, lambda t: F.startswith(t, F.lit("kind:"))), F.lit(1)), "^kind:", "")
    return F.when(own.isin(kinds), own).when(tag.isin(kinds), tag).otherwise("raw_note")


def has_kind(metadata: Column, tags: Column, kind: str) -> Column:
    own = F.get_json_object(F.when(F.try_parse_json(metadata).isNotNull(), metadata), "$.memoryKind")
    return F.coalesce(F.array_contains(tags, f"kind:{kind}") | (own == kind), own == kind, F.array_contains(tags, f"kind:{kind}"), F.lit(False))


def tags_any(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def tags_all(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0, F.lit(False))


def with_entity(rows: DataFrame, links: DataFrame, entities: DataFrame, aliases: DataFrame, entity_id=None, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows linked to an entity: by its id, which comes first, or by its name or an alias, and its type."""
    if entity_id is not None:
        held = links.where(F.col("entity_id") == entity_id)
    else:
        met = entities.select(F.col("id").alias("entity_id"), "type", "name").join(aliases.select("entity_id", "alias"), "entity_id", "left")
        if name is not None:
            met = met.where((F.col("name") == name) | (F.col("alias") == name))
        if kind is not None:
            met = met.where(F.col("type") == kind)
        held = links.join(met.select("entity_id").distinct(), "entity_id", "left_semi")
    return rows.join(held.select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi")


def visible_to(owner: Column, user: str) -> Column:
    return owner.isNull() | (owner == user)


def within(column: Column, start=None, end=None) -> Column:
    """An inclusive range, open where no bound is given; null is outside."""
    ok = column.isNotNull()
    ok = ok if start is None else ok & (column >= F.lit(start))
    return ok if end is None else ok & (column <= F.lit(end))


def query_terms(query: str, most: int = 6) -> list[str]:
    import re

    return [t for t in re.split(r"[\s,，。；;]+", query) if t][:most]


def like_search(rows: DataFrame, query: str, fields: list[str], limit: int = 20) -> DataFrame:
    """id, score, degraded: rows that hold a term of the query in a field, newest first. For when full text finds nothing."""
    terms = query_terms(query)
    if not terms:
        return rows.limit(0).select("id", F.lit(0.01).alias("score"), F.lit("fts_unavailable").alias("degraded"))
    held = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t.lower())) for t in terms for f in fields])
    return rows.where(held).orderBy(F.desc("updated"), "id").limit(limit).select("id", F.lit(0.01).alias("score"), F.lit("fts_unavailable").alias("degraded"))


def without_superseded(rows: DataFrame, edges: DataFrame, active: DataFrame) -> DataFrame:
    """rows that no active memory replaces, at any time. edges: superseder, superseded; active: id."""
    gone = edges.join(active.select(F.col("id").alias("superseder")), "superseder", "left_semi").select(F.col("superseded").alias("id")).distinct()
    return rows.join(gone, "id", "left_anti")


def allowed_at(candidates: DataFrame, memories: DataFrame, edges: DataFrame, moment: Column, expired: bool = False, superseded: bool = False) -> DataFrame:
    """The candidates (id) that may be shown: valid at the moment, and not replaced by an active memory."""
    own = memories.join(candidates.select("id").distinct(), "id", "left_semi")
    own = own if expired else valid_at(own.withColumn("valid_from", F.coalesce("valid_from", "created")), moment)
    own = own if superseded else without_superseded(own, edges, memories.where("status = 'active'"))
    return own.select("id")


def clamped(limit: int, default: int, most: int) -> int:
    """A caller's limit, within 1 and most."""
    return max(1, min(default if limit is None else limit, most))
