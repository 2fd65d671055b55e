"""Streams run to their end with availableNow, against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import loops as P
from tarn.operators import mailbox as M
from tarn.streaming import streams as S

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Events in time order, in three files."""
    rnd = random.Random(3)
    rows = [(i, START + dt.timedelta(seconds=60 * i + rnd.randrange(50)), rnd.randrange(4), rnd.choice(["error", "error", "view"]), float(rnd.randrange(1, 30)), rnd.choice("ab")) for i in range(300)]
    path = str(tmp_path_factory.mktemp("log"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, run long, event_type string, tokens double, signature string")
    for k in range(3):
        df.where(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def ran(stream, name, tmp_path, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_hourly_counts(spark, log, tmp_path):
    path, df = log
    got = ran(S.hourly_counts(S.event_log(spark, path, df.schema)), "hourly", tmp_path, "complete")
    want = df.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sliding_counts(spark, log, tmp_path):
    path, df = log
    what = F.col("event_type") == "error"
    got = ran(S.sliding_counts(S.event_log(spark, path, df.schema), what, "2 hours", "1 hour"), "sliding", tmp_path, "complete")
    want = df.where(what).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark, log, tmp_path):
    path, df = log
    got = ran(S.sessions(S.event_log(spark, path, df.schema), "run", "5 minutes"), "sessions", tmp_path, "complete")
    want = df.groupBy("run", F.session_window("ts", "5 minutes")).agg(F.count("*").alias("n")).select("run", "session_window.start", "session_window.end", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_once_within(spark, log, tmp_path):
    path, df = log
    got = ran(S.once_within(S.event_log(spark, path, df.schema), ["run", "event_type"], "10 minutes"), "once", tmp_path, "append")
    ids = [r["event_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) < df.count() and {(r["run"], r["event_type"]) for r in got.collect()} == {(r["run"], r["event_type"]) for r in df.collect()}
    assert M.debounced(df, ["run", "event_type"], 600).count() <= df.count()


def test_pair_counts(spark, log, tmp_path):
    path, df = log
    searches = df.groupBy(F.floor(F.col("event_id") / 6).alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "run"))), lambda x: x["run"]).alias("ids"))
    out = str(tmp_path / "searches")
    searches.repartition(2).write.parquet(out)
    got = ran(S.pair_counts(S.event_log(spark, out, searches.schema)), "pairs", tmp_path, "complete")
    want = {}
    for r in searches.collect():
        ids = r["ids"][:5]
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                want[(ids[i], ids[j])] = want.get((ids[i], ids[j]), 0) + 1
    assert {(r["source"], r["target"]): r["times"] for r in got.collect()} == want


def test_run_states(spark, log, tmp_path):
    path, df = log
    stream = S.event_log(spark, path, df.schema).withColumn("failed", F.col("event_type") == "error")
    got = {}
    for r in ran(S.run_states(stream, 400.0), "states", tmp_path, "update").collect():
        if r["run"] not in got or r["iteration"] > got[r["run"]]["iteration"]:
            got[r["run"]] = r
    batch = df.withColumn("failed", F.col("event_type") == "error")
    last = {}
    for r in P.attempts(batch, "run", ["ts", "event_id"]).collect():
        if r["run"] not in last or r["iteration"] > last[r["run"]]["iteration"]:
            last[r["run"]] = r
    reasons = {r["run"]: r["reason"] for r in P.tripped(batch, "run", ["ts", "event_id"], 400.0).collect()}
    for run, r in got.items():
        want = last[run]
        assert (r["iteration"], r["failures"], r["same"], round(r["tokens"], 6), r["reason"]) == (want["iteration"], want["failures"], want["same"], round(want["tokens_used"], 6), reasons[run])


def test_leases(spark, log, tmp_path):
    path, df = log
    beats = S.event_log(spark, path, df.schema).select("run", F.col("signature").alias("worker"), "ts")
    got = ran(S.leases(beats, 3600), "leases", tmp_path, "update").collect()
    assert {r["event"] for r in got} == {"held"} and {r["run"] for r in got} == {0, 1, 2, 3}


def test_digests_through_failure_and_restart(spark, log, tmp_path, monkeypatch):
    """A batch fails after its digests were written; the stream starts again from its checkpoint, twice."""
    monkeypatch.setattr(S, "WHOLE", 2)
    path, df = log
    out, failing = str(tmp_path / "out"), {1}

    def make(batch, known):
        newer = batch.join(known, "thread_id", "left").where("through IS NULL OR updated > through")
        return newer.groupBy("thread_id").agg(F.count("*").alias("n"), F.max("through").alias("through"))

    def run():
        write = S.digests(make, out)

        def tried(batch, number):
            write(batch, number)
            if number in failing:
                failing.remove(number)
                raise RuntimeError("the driver was lost")

        stream = S.event_log(spark, path, df.schema).select(F.col("run").alias("thread_id"), F.col("event_id").alias("updated"))
        query = stream.writeStream.foreachBatch(tried).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as e:
            assert "the driver was lost" in str(e)

    for _ in range(3):
        run()
    made = spark.read.parquet(f"{out}/digests")
    assert not failing and made.agg({"n": "sum"}).first()[0] == 300 and made.select("batch").distinct().count() == 3
    last = made.where("through IS NOT NULL").agg(F.min("batch"), F.max("batch")).first()
    assert tuple(last) == (1, 2)
    got = {r["thread_id"]: r["through"] for r in S.coverage(spark, out, 3, "").collect()}
    assert got == {r["run"]: r["t"] for r in df.groupBy("run").agg(F.max("event_id").alias("t")).collect()}
    # records that came before are no news, whatever batch brings them again
    S.digests(make, out)(df.select(F.col("run").alias("thread_id"), F.col("event_id").alias("updated")), 3)
    assert spark.read.parquet(f"{out}/digests/batch=3").count() == 0


def test_refine_queue_by_count_idleness_and_flush(spark, tmp_path):
    """Two spaces; the stream stops and starts again between the batches."""
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [
        [("a", i, at(i), False) for i in range(7)] + [("b", 50, at(3), False)],
        [("a", 7, at(8), False), ("a", 8, at(8), False), ("b", 51, at(7), False), ("b", 52, at(35), False)],
        [("a", 9, at(36), False), ("a", 10, at(40), False), ("b", None, at(41), True), ("b", 53, at(42), False)],
        [("c", 99, at(90), False)],
        [("c", 100, at(91), False)],
    ]
    schema, path = "space string, id long, ts timestamp, flush boolean", str(tmp_path / "queue")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = S.refine_queue(S.event_log(spark, path, schema))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r["space"], [*r["ids"]], r["cause"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", [0, 1, 2, 3, 4], "full"), ("a", [5, 6, 7, 8], "idle"), ("a", [9, 10], "idle"), ("b", [50, 51], "idle"), ("b", [52], "flush"), ("b", [53], "idle")]
