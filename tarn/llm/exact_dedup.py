"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each sender (a run of rows of one partition) sorts the distinct fingerprints of
   its texts and sends each owner of a hash range one compressed message.
2. An owner merges its messages and answers each with a bitmap: which of these
   fingerprints did another sender hold too, or this one twice?
3. Rows whose bit is set are the suspects. Only their texts are shuffled; grouping
   by the text itself compares all bytes, so equal fingerprints alone never make a
   duplicate. The suspects' fingerprints go to the scan of the texts by broadcast
   where their counted number is small, and by a shuffle beyond.

A sender sends each fingerprint once, however many rows share it, so a text that
fills a third of the table costs an owner one entry per sender.

Fingerprints have log2(rows) + slack bits: about one row in 2**slack is a false
suspect, at every size of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tarn.llm import golomb
from tarn.llm.common import ascii_lower, owners, small_batches, without_dropped, written

SENDER_ROWS = 1 << 18
OWNER_ROWS = 1 << 22  # fingerprints of an owner, about: 32 MB, and as much again while they are merged
BROADCAST_FINGERPRINTS = 1 << 21  # 32 MB as a hash relation; more suspects than that are joined by a shuffle
HOME = "sender long, owner int, n int, k int, code binary, ids binary, slot binary, multi binary, shas binary"


def _messages(batches, bits: int, n_owners: int):
    """One row per sender and owner: the coded fingerprints, and the sender's own rows."""
    part, turn = TaskContext.get().partitionId(), 0

    def flush(ids, fps, shas):
        fp = np.concatenate(fps)
        owner = (fp * np.uint64(n_owners)) >> np.uint64(bits)
        order = np.lexsort((fp, owner))
        ids, fp, owner, shas = np.concatenate(ids)[order], fp[order], owner[order], np.concatenate(shas)[order]
        edges = np.flatnonzero(np.diff(owner, prepend=np.uint64(n_owners)))
        for a, b in zip(edges, [*edges[1:], len(fp)], strict=True):
            distinct, slot, count = np.unique(fp[a:b], return_inverse=True, return_counts=True)
            k, code = golomb.encode(distinct - (np.uint64(owner[a]) << np.uint64(bits)) // np.uint64(n_owners), bits - np.log2(n_owners))
            yield {
                "sender": (part << 32) | turn, "owner": int(owner[a]), "n": len(distinct), "k": k, "code": code,
                "ids": ids[a:b].tobytes(), "slot": slot.astype("<i4").tobytes(), "multi": np.packbits(count > 1).tobytes(), "shas": shas[a:b].tobytes(),
            }

    held: list[tuple] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append((batch["row"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits), np.frombuffer(b"".join(batch["sha"]), "V32")))
        rows += len(batch)
        if rows >= SENDER_ROWS:
            yield pd.DataFrame(flush(*zip(*held, strict=True)))
            held, rows, turn = [], 0, turn + 1
    if held:
        yield pd.DataFrame(flush(*zip(*held, strict=True)))


def _answers(group: pd.DataFrame, bits: int, n_owners: int) -> pd.DataFrame:
    """An owner's bitmaps: fingerprints that came from two senders, or twice from one.

    The first row also holds these fingerprints themselves.
    """
    lists = [golomb.decode(n, k, code) for n, k, code in zip(group["n"], group["k"], group["code"], strict=True)]
    multi = [x[np.unpackbits(np.frombuffer(m, np.uint8))[: len(x)].astype(bool)] for x, m in zip(lists, group["multi"], strict=True)]
    values, counts = np.unique(np.concatenate(lists + multi), return_counts=True)
    shared = values[counts > 1]
    low = (np.uint64(group["owner"].iloc[0]) << np.uint64(bits)) // np.uint64(n_owners)
    fps = [(shared + low).astype("<i8").tobytes(), *[b""] * (len(group) - 1)]

    def held(x):
        at = np.minimum(np.searchsorted(shared, x), max(0, len(shared) - 1))
        return shared[at] == x if len(shared) else np.zeros(len(x), bool)

    return pd.DataFrame({"sender": group["sender"], "owner": group["owner"], "bitmap": [np.packbits(held(x)).tobytes() for x in lists], "fps": fps})


def _marked(batches):
    """The senders' rows again, each with its bit."""
    for batch in batches:
        for n, ids, slot, shas, bitmap in zip(batch["n"], batch["ids"], batch["slot"], batch["shas"], batch["bitmap"], strict=True):
            bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
            sha = np.frombuffer(shas, "V32")
            yield pd.DataFrame({"row": np.frombuffer(ids, np.int64), "sha": [x.tobytes() for x in sha], "suspect": bits[np.frombuffer(slot, "<i4")]})


def _fingerprints(batches):
    for batch in batches:
        yield pd.DataFrame({"fp": np.frombuffer(b"".join(batch["fps"]), "<i8")})


def exchange_owners(rows: int, partitions: int, bits: int) -> int:
    """As many owners as there are partitions, and more where one would hold over OWNER_ROWS fingerprints."""
    return min(max(partitions, rows // OWNER_ROWS + 1), 1 << 7 if bits > 57 else 1 << (63 - bits))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: int = 12) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as
    empty. Of equal texts the largest id stays; rows that repeat an id and a text
    all count in group_size, and all copies of the largest id are marked kept. Rows
    with a null id count in group_size; a group of null ids only keeps them all. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("row"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    null_id = F.lit(-(2**63))  # numpy has no null; no id is this number
    rows = rows.withColumn("row", F.coalesce(F.col("row").cast("long"), null_id))
    count = docs.count()
    bits = int(min(56, max(8, np.ceil(np.log2(max(2, count)))) + slack))
    # each owner of the exchange holds a range of the fingerprints: rows / owners of them
    n_owners = exchange_owners(count, owners(spark), bits)
    prints = rows.select("row", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    home = written(prints.mapInPandas(lambda it: _messages(it, bits, n_owners), HOME), "fingerprints")
    messages = home.select("sender", "owner", "n", "k", "code", "multi")
    answers = written(messages.groupBy("owner").applyInPandas(lambda g: _answers(g, bits, n_owners), "sender long, owner int, bitmap binary, fps binary"), "answers")
    marked = home.select("sender", "owner", "n", "ids", "slot", "shas").join(answers.drop("fps"), ["sender", "owner"]).mapInPandas(_marked, "row long, sha binary, suspect boolean")
    shared = answers.select("fps").where("length(fps) > 0")
    n_shared = shared.agg(F.sum(F.length("fps")) / 8).first()[0] or 0
    shared = shared.mapInPandas(_fingerprints, "fp long")
    shared = F.broadcast(shared) if n_shared <= BROADCAST_FINGERPRINTS else shared
    # byte verification: the groups are the suspects' texts themselves
    suspects = rows.join(shared, F.expr(f"shiftrightunsigned(xxhash64(norm), {64 - bits})") == shared["fp"], "left_semi")
    groups = (
        suspects.groupBy("norm").agg(F.max("row").alias("keep"), F.count("*").alias("size"))
        .where("size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "size", F.lit(True).alias("suspect"))
    )
    out = marked.join(groups, ["sha", "suspect"], "left")
    keep = F.coalesce("keep", "row")
    shown = lambda c: F.when(c != null_id, c)
    return out.select(
        shown(F.col("row")).alias(id_col),
        shown(keep).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("row") == keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one id per distinct text.

    Rows that repeat the id and the text of a row that stays also stay.
    """
    return without_dropped(docs, exact_duplicates(docs, id_col, text_col), id_col)
