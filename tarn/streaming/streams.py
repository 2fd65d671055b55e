"""Streams over event logs: cursors, counts, debounced sessions, co-hits, run states, digests.

Each takes and returns streaming DataFrames; the tests run them with availableNow against
the batch operator of the same name. Late data is what the watermark says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from tarn.operators.loops import MOST_ITERATIONS, NO_PROGRESS, STAGNATION

STATE = "iteration long, failures long, same long, tokens double, signature string, reason string"


def event_log(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """The log's files as a stream: what was read before is the cursor that the checkpoint keeps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def hourly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def sliding_counts(events: DataFrame, what: Column, length: str = "1 day", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, n: how often something happened within each window, such as degraded searches in a day."""
    return events.withWatermark("ts", late).where(what).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """key, start, end, n: spells of activity; one ends when nothing came for the gap."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_within(events: DataFrame, keys: list[str], span: str = "1 minute") -> DataFrame:
    """The first record of a key within the span; the reference counts the span from the latest instead."""
    return events.withWatermark("ts", span).dropDuplicatesWithinWatermark(keys)


def pair_counts(hits: DataFrame) -> DataFrame:
    """source, target, times: how often two were among a search's first hits. hits: ids, a search's hits in rank order."""
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return hits.withColumn("ids", F.slice("ids", 1, 5)).select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("times"))


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState, budget: float | None) -> Iterator[pd.DataFrame]:
    """A run's state after its new events, in order."""
    iteration, failures, same, tokens, signature, reason = state.get if state.exists else (0, 0, 0, 0.0, None, None)
    for row in pd.concat([*frames]).sort_values(["ts", "event_id"]).itertuples():
        iteration, tokens = iteration + 1, tokens + row.tokens
        if row.failed:
            same = same + 1 if failures and row.signature == signature else 1
            failures, signature = failures + 1, row.signature
        else:
            failures = same = 0
        if reason is None:
            if failures >= STAGNATION and same >= STAGNATION:
                reason = "stagnation"
            elif failures >= NO_PROGRESS:
                reason = "no-progress"
            elif budget and tokens >= budget:
                reason = "token-budget"
            elif iteration >= MOST_ITERATIONS:
                reason = "max-iterations"
    state.update((iteration, failures, same, tokens, signature, reason))
    yield pd.DataFrame([(*key, iteration, failures, same, tokens, reason)], columns=["run", "iteration", "failures", "same", "tokens", "reason"])


def run_states(events: DataFrame, budget: float | None = None) -> DataFrame:
    """run, iteration, failures, same, tokens, reason after each batch: the circuit breaker as a state of each run.

    events: run, ts, event_id, failed, signature, tokens. A run's events are to arrive in
    order from batch to batch; within a batch they are sorted.
    """
    step = lambda key, frames, state: _advance(key, frames, state, budget)
    return events.groupBy("run").applyInPandasWithState(step, "run long, iteration long, failures long, same long, tokens double, reason string", STATE, "update", GroupStateTimeout.NoTimeout)


def _lease(key, frames: Iterator[pd.DataFrame], state: GroupState, seconds: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (worker,) = state.get
        state.remove()
        yield pd.DataFrame([(*key, worker, "expired")], columns=["run", "worker", "event"])
        return
    last = pd.concat([*frames]).sort_values(["ts", "worker"]).iloc[-1]
    state.update((last["worker"],))
    state.setTimeoutDuration(seconds * 1000)
    yield pd.DataFrame([(*key, last["worker"], "held")], columns=["run", "worker", "event"])


def leases(beats: DataFrame, seconds: int = 60) -> DataFrame:
    """run, worker, event: held at each beat, expired when none came for so long by the clock. beats: run, worker, ts."""
    return beats.groupBy("run").applyInPandasWithState(lambda k, f, s: _lease(k, f, s, seconds), "run long, worker string, event string", "worker string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _queued(key, frames: Iterator[pd.DataFrame], state: GroupState, most: int, idle: float) -> Iterator[pd.DataFrame]:
    """The groups of queued records that are due, and what still waits as state."""
    waiting, last = ([*state.get[0]], state.get[1]) if state.exists else ([], 0.0)
    out: list[tuple] = []

    def due(cause: str) -> None:
        if waiting:
            out.append((*key, [*waiting], cause))
            waiting.clear()

    if state.hasTimedOut:
        due("idle")
    else:
        for row in pd.concat([*frames]).sort_values(["ts", "id"]).itertuples():
            at = row.ts.timestamp()
            if at - last >= idle:
                due("idle")
            last = max(last, at)
            if row.flush:
                due("flush")
                continue
            waiting.append(int(row.id))
            if len(waiting) >= most:
                due("full")
    if waiting:
        state.update((waiting, last))
        state.setTimeoutTimestamp(int((last + idle) * 1000))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["space", "ids", "cause"])


def refine_queue(queued: DataFrame, most: int = 5, idle_seconds: float = 600, late: str = "0 seconds") -> DataFrame:
    """space, ids, cause: what is to be refined together: most records (full), those that wait when none came for so long (idle), or when a flush is asked for.

    queued: space, id, ts, flush; a flush has no id. Fewer than most records wait in a
    space's state. Idle spells count by the records' own times, so they end alike in any
    run: by the next record, or by the watermark.
    """
    step = lambda key, frames, state: _queued(key, frames, state, most, idle_seconds)
    rows = queued.select("space", F.coalesce("id", F.lit(-1)).cast("long").alias("id"), "ts", F.coalesce("flush", F.lit(False)).alias("flush"))
    return rows.withWatermark("ts", late).groupBy("space").applyInPandasWithState(step, f"space {dict(queued.dtypes)['space']}, ids array<long>, cause string", "waiting array<long>, last double", "append", GroupStateTimeout.EventTimeTimeout)


WHOLE = 64  # every so many batches, all marks are written anew


def coverage(spark: SparkSession, out: str, before: int, schema: str) -> DataFrame:
    """thread_id, through: how far each thread was covered by the batches before the given one. schema: of these two columns."""
    try:
        marks = spark.read.parquet(f"{out}/marks")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    since = (before - 1) // WHOLE * WHOLE
    return marks.where((F.col("batch") >= since) & (F.col("batch") < before)).groupBy("thread_id").agg(F.max("through").alias("through"))


def digests(make: Callable[[DataFrame, DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: make(batch, coverage) gives a batch's digests, and each thread's mark moves on to its newest record.

    Digests are written to out/digests and marks to out/marks, both under the batch's
    number. A batch sees the marks of batches before it only. So one that is run again,
    after a failure or from the checkpoint of a stopped stream, sees what it saw, and
    writes the same folders again: nothing is doubled, and nothing is lost.
    """

    def write(batch: DataFrame, number: int) -> None:
        kinds = dict(batch.dtypes)
        known = coverage(batch.sparkSession, out, number, f"thread_id {kinds['thread_id']}, through {kinds['updated']}")
        make(batch, known).write.mode("overwrite").parquet(f"{out}/digests/batch={number}")
        own = batch.groupBy("thread_id").agg(F.max("updated").alias("through"))
        if number % WHOLE == 0:
            own = own.unionByName(known).groupBy("thread_id").agg(F.max("through").alias("through"))
        own.write.mode("overwrite").parquet(f"{out}/marks/batch={number}")

    return write
