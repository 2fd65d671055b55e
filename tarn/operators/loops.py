"""The log of agent loops: idempotent starts, events, checkpoints, leases, the circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.rules import canonical_json

# fixed values: checkpoints, equal errors in a row and failures in a row that end a run
MOST_ITERATIONS, STAGNATION, NO_PROGRESS = 10, 3, 5


def request_hash(request: Column) -> Column:
    """Of a request's JSON, whatever the order of its keys."""
    return F.sha2(canonical_json(request), 256)


def started(requests: DataFrame) -> DataFrame:
    """place, key, run, outcome of requests to start (place, key, request): the first of a key starts its run.

    The same request again is a replay of that run; another one under the key is a conflict.
    """
    first = Window.partitionBy("key").orderBy("place")
    rows = requests.withColumn("_hash", request_hash(F.col("request"))).withColumns({"_first": F.first("_hash").over(first), "run": F.first("place").over(first)})
    outcome = F.when(F.col("place") == F.col("run"), "started").when(F.col("_hash").eqNullSafe(F.col("_first")), "replayed").otherwise("conflict")
    return rows.select("place", "key", F.when(outcome != "conflict", F.col("run")).alias("run"), outcome.alias("outcome"))


def sequenced(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """events with sequence, from 1 in each run."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def page_after(events: DataFrame, run: str, cursor: Column, limit: int = 50, most: int = 200) -> DataFrame:
    """Each run's next events past its cursor, limit (of most) of them."""
    rows = events.where(F.col("sequence") > cursor)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy("sequence"))).where(F.col("_r") <= max(1, min(limit, most))).drop("_r")


def attempts(events: DataFrame, run: str, order: list[str | Column]) -> DataFrame:
    """events (failed, signature, tokens) with iteration, failures in a row, same (equal signatures in a row among them) and tokens_used."""
    so_far = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"iteration": F.count("*").over(so_far), "tokens_used": F.sum("tokens").over(so_far), "_passed": F.sum((~F.col("failed")).cast("long")).over(so_far)})
    within = Window.partitionBy(run, "_passed").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum(F.col("failed").cast("long")).over(running))
    # a run of equal signatures ends where one differs from the one before
    rows = rows.withColumn("_new", (F.col("failed") & ~F.col("signature").eqNullSafe(F.lag("signature").over(within))).cast("long"))
    rows = rows.withColumn("_spell", F.sum("_new").over(running))
    same = F.sum(F.col("failed").cast("long")).over(Window.partitionBy(run, "_passed", "_spell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("same", F.when(F.col("failed"), same).otherwise(0)).drop("_passed", "_new", "_spell")


def tripped(events: DataFrame, run: str, order: list[str | Column], token_budget: float | None = None) -> DataFrame:
    """The first event of each run at which the circuit breaker ends it, with the reason: the first rule of four that holds."""
    rows = attempts(events, run, order)
    reason = F.when((F.col("failures") >= STAGNATION) & (F.col("same") >= STAGNATION), "stagnation").when(F.col("failures") >= NO_PROGRESS, "no-progress")
    if token_budget:
        reason = reason.when(F.col("tokens_used") >= token_budget, "token-budget")
    reason = reason.when(F.col("iteration") >= MOST_ITERATIONS, "max-iterations")
    ended = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    return ended.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where("_r = 1").drop("_r")


def checkpointed(writes: DataFrame, run: str) -> DataFrame:
    """writes (place, expected, worker, at, lease_seconds) with accepted and version.

    A write is accepted if it expects its run's present version and no other worker holds
    the lease; it raises the version and takes the lease. Each run's writes, of which a
    loop has few, are folded in order.
    """
    step = lambda s, w: F.struct(
        F.when(_fits(s, w), s["version"] + 1).otherwise(s["version"]).alias("version"),
        F.when(_fits(s, w), w["worker"]).otherwise(s["owner"]).alias("owner"),
        F.when(_fits(s, w), w["at"] + w["lease_seconds"]).otherwise(s["until"]).alias("until"),
        F.concat(s["out"], F.array(F.struct(w["place"].alias("place"), _fits(s, w).alias("accepted"), F.when(_fits(s, w), s["version"] + 1).otherwise(s["version"]).alias("version")))).alias("out"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("version"), F.lit(None).cast("string").alias("owner"), F.lit(0).cast("long").alias("until"), F.array().cast("array<struct<place:bigint,accepted:boolean,version:bigint>>").alias("out"))
    typed = [F.col("place").cast("long").alias("place"), F.col("expected").cast("long").alias("expected"), F.col("worker").cast("string").alias("worker"), F.col("at").cast("long").alias("at"), F.col("lease_seconds").cast("long").alias("lease_seconds")]
    ordered = writes.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*typed))).alias("w"))
    return ordered.select(run, F.explode(F.aggregate("w", zero, step, lambda s: s["out"])).alias("x")).select(run, "x.place", "x.accepted", "x.version")


def _fits(s: Column, w: Column) -> Column:
    return (w["expected"] == s["version"]) & (s["owner"].isNull() | (s["owner"] == w["worker"]) | (s["until"] <= w["at"]))


def expired_leases(runs: DataFrame, now: Column) -> DataFrame:
    return runs.where(F.col("lease_owner").isNotNull() & (F.col("lease_expires_at") <= now))
