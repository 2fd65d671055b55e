"""Packing of documents into fixed-length sequences by cutting-stock column generation.

A document of n ids is cut at every multiple of the capacity; what is left over is one
piece shorter than the capacity. Whole pieces fill sequences of their own. The rest is a
cutting-stock problem on the histogram of piece lengths, in classes of a few ids:

1. A linear program asks for the fewest sequences that hold all pieces; its columns are
   patterns, how many pieces of each class share a sequence.
2. A knapsack dynamic program over the program's dual prices finds the pattern worth
   most; while it is worth more than one sequence, it enters the program.
3. The patterns' amounts are rounded down, and first-fit-decreasing patterns take what
   rounding left over. Pieces are ranked within their class by a distributed count, and
   a piece's rank gives its pattern, sequence and place.

The driver sees the histogram only: capacity / width classes, at any size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.taskcontext import TaskContext

from tarn.llm.common import small_batches, written
from tarn.llm.tokens import binary_array, encode_column, spread

WIDTH = 8
PLAN = "of int, low long, high long, each long, base long"


def _knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..m with sizes summing to capacity at most."""
    m = len(prices)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        sizes = min(m, c)
        worth = best[c - sizes : c][::-1] + prices[:sizes]
        j = int(worth.argmax())
        best[c], choice[c] = (worth[j], j + 1) if worth[j] > best[c - 1] + 1e-15 else (best[c - 1], 0)
    pattern, c = np.zeros(m, np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination with row exchanges: a few hundred rank-one steps, in one thread."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(both[i:, i]).argmax())
        both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        both -= factors[:, None] * both[i]
    return both[:, n:]


def solve(demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering demand exactly.

    demand[i]: pieces of size i + 1; capacity: in the same unit. The linear program is
    solved by the revised simplex method with the basis inverse kept; prices are updated
    with it. Stopping early, after so many rounds, only costs some padding.
    """
    m, left = len(demand), demand.astype(np.int64).copy()
    rows = np.flatnonzero(left)
    used: list[tuple[np.ndarray, int]] = []
    if len(rows):
        need = left[rows].astype(float)
        patterns = np.zeros((m, len(rows)), np.int64)  # the basis: one size only in each column at first
        patterns[rows, np.arange(len(rows))] = capacity // (rows + 1)
        inverse = np.diag(1.0 / patterns[rows, np.arange(len(rows))])
        amount = inverse @ need
        for turn in range(rounds):
            prices = np.zeros(m)
            prices[rows] = np.maximum(0, inverse.sum(axis=0))
            value, pattern = _knapsack(prices, capacity)
            if value <= 1 + 1e-7:
                break
            column = inverse @ pattern[rows].astype(float)
            ratio = np.where(column > 1e-9, amount / np.where(column > 1e-9, column, 1), np.inf)
            out = int(ratio.argmin())
            patterns[:, out] = pattern
            step = ratio[out]
            amount = np.maximum(0, amount - step * column)
            amount[out] = step
            pivot = inverse[out] / column[out]
            inverse -= np.outer(column, pivot)
            inverse[out] = pivot
            if turn % 200 == 199:
                inverse = _inverse(patterns[rows].astype(float))
                amount = np.maximum(0, inverse @ need)
        for j in np.argsort(-amount):
            fits = patterns[:, j] > 0
            times = int(min(np.floor(amount[j] + 1e-7), (left[fits] // patterns[fits, j]).min()))
            if times > 0:
                used.append((patterns[:, j].copy(), times))
                left -= times * patterns[:, j]
    while left.any():  # what rounding left over, largest pieces first
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            k = int(min(left[i], room // (i + 1)))
            pattern[i] += k
            room -= k * (i + 1)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used.append((pattern, times))
        left -= times * pattern
    return used


def plan(histogram: dict[int, int], capacity: int, width: int = WIDTH) -> tuple[list[tuple], int]:
    """Rows (class, low, high, each, base) and the number of sequences.

    Ranks low to high of a class go to sequences base, base + 1 ..., each of them
    taking so many.
    """
    unit = capacity // width
    demand = np.zeros(unit, np.int64)
    for size, n in histogram.items():
        demand[size - 1] = n
    rank, base, rows = np.zeros(unit, np.int64), 0, []
    for pattern, times in solve(demand, unit):
        for i in np.flatnonzero(pattern):
            taken = int(pattern[i]) * times
            rows.append((int(i) + 1, int(rank[i]), int(rank[i]) + taken, int(pattern[i]), base))
            rank[i] += taken
        base += times
    return rows, base


def _pieces(batches, path: str, end_id: int, capacity: int):
    for batch in batches:
        for first, ids, sizes in encode_column(batch.column("text"), path, end_id):
            each = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), each)
            start = spread(np.zeros(len(sizes), np.int64), each) * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            raw = binary_array(ids.view(np.uint8), np.append(0, np.cumsum(4 * length)))  # pieces lie in the order of the ids
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(first + doc)), pa.array(start), pa.array(length), pa.array(sizes[doc]), raw], names=["doc", "start", "length", "doc_tokens", "ids"])


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: id_col, start, length, doc_tokens, ids (little-endian unsigned 32-bit bytes).

    A null text is empty: its only id is end_id. Ids may be null or repeat; each row is
    a document. An empty table gives no pieces. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = rows.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, capacity), "doc long, start long, length long, doc_tokens long, ids binary")
    return out.withColumnRenamed("doc", id_col)


def _numbered(batches):
    """Adds each piece's task, its number in the task, and its rank among the task's pieces of its class."""
    part, seen, counts = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
    for batch in batches:
        classes = batch.column("class").to_numpy()
        n = len(classes)
        if not n:
            continue
        counts = np.pad(counts, (0, max(0, int(classes.max()) + 1 - len(counts))))
        order = np.argsort(classes, kind="stable")
        new = np.bincount(classes, minlength=len(counts))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(new) - new, new)
        rank += counts[classes]
        counts += new
        for name, values in (("task", np.full(n, part, np.int32)), ("row", (part << 33) + seen + np.arange(n)), ("local", rank)):
            batch = batch.append_column(name, pa.array(values))
        seen += n
        yield batch


def pack(pieces: DataFrame, capacity: int = 2048, width: int = WIDTH) -> DataFrame:
    """pieces with sequence_id and offset: where each lies.

    pieces: length (1 to capacity) and any other columns, whatever their names; equal
    rows are separate pieces. Columns named sequence_id or offset are replaced.
    Sequences number from 0 without gaps, and offsets within one are gapless from 0.
    A power of two as capacity, and as width, keeps the classes whole. No pieces give no
    sequences. A length that is null or out of range is an error.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    length = F.col("length").cast("long")
    checked = F.when((length >= 1) & (length <= capacity), length).otherwise(F.raise_error(F.lit("a piece's length must be 1 to capacity")).cast("long"))
    # a piece's own columns travel in one struct, apart from what is added;
    # tasks rank the pieces they hold, so no task ever gathers a class
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("piece"), checked.alias("size")).withColumn("class", F.ceil(F.col("size") / width).cast("int"))
    added = [StructField("task", IntegerType()), StructField("row", LongType()), StructField("local", LongType())]
    rows = written(rows.mapInArrow(_numbered, StructType([*rows.schema.fields, *added])), "pieces")
    counts = rows.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n")).drop("n")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # capacity / width rows
    layout, _ = plan(histogram, capacity, width)
    layout = spark.createDataFrame(layout, PLAN)  # patterns times classes: bounded by capacity / width as well
    ranked = rows.join(before, ["class", "task"]).withColumn("rank", F.col("before") + F.col("local"))
    placed = ranked.join(F.broadcast(layout), (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(rank - low) div each"))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "row").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(along), F.lit(0))
    return placed.select(*[F.col("piece").getField(c).alias(c) for c in own], "sequence_id", offset.alias("offset"))


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence: sequence_id, n_ids, ids (its pieces' ids in order), docs. At most capacity ids each.

    packed: what pack() gives for pieces with ids. Null document ids stay null in docs; no pieces give no rows.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("doc")))).alias("p"), F.sum("length").alias("n_ids"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", "n_ids", ids.alias("ids"), F.transform("p", lambda x: x["doc"]).alias("docs"))
