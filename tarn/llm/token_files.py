"""Token files: ids in the minimum vocabulary bits, in blocks with random access.

A token file is a folder of Parquet parts, written and committed by Spark. Each row is
a block: whole documents in ascending id order, their ids packed at a fixed width.
The i-th id of a block starts at bit i * width, so numpy reads any slice of it at
once, and the block's columns say which documents and positions it holds:

    shard, block   the block's place; shards are ranges of ascending document ids
    first          ids before the block in its shard
    width, n_ids   bits per id, ids in the block
    n_null         how many of its documents have no id; they come first
    docs, starts   its documents (long) and the offset in the block of each (long)
    min_doc, max_doc
    payload        the packed ids

positions() gives shards their offsets in the whole corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tarn.llm.common import small_batches
from tarn.llm.golomb import pack, unpack
from tarn.llm.tokens import binary_array, encode_column

BLOCK_IDS = 1 << 17
FORMAT = "shard int, block int, first long, width int, n_ids long, n_null int, min_doc long, max_doc long, docs binary, starts binary, payload binary"

ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in FORMAT.split(", "))])


def width_of(vocabulary: int) -> int:
    """The minimum bits for ids below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def _blocks(batches, path: str, width: int, end_id: int):
    shard, block, first = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    n_held = 0

    def flush():
        nonlocal block, first, n_held
        docs = pa.concat_arrays([x[0] for x in held])
        flat, sizes = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        named = docs.drop_null().to_numpy()
        out = {
            "shard": shard, "block": block, "first": first, "width": width, "n_ids": len(flat), "n_null": docs.null_count,
            "min_doc": int(named[0]) if len(named) else None, "max_doc": int(named[-1]) if len(named) else None,
            "docs": docs.fill_null(0).to_numpy().astype("<i8").tobytes(), "starts": (np.cumsum(sizes) - sizes).astype("<i8").tobytes(), "payload": pack(flat.astype("<u8"), width),
        }
        block, first, n_held = block + 1, first + len(flat), 0
        held.clear()
        return pa.RecordBatch.from_pylist([out], ARROW)

    for batch in batches:
        for run, ids, sizes in encode_column(batch.column("text"), path, end_id):
            ends, at = np.append(0, np.cumsum(sizes)), 0
            while at < len(sizes):
                end = min(len(sizes), max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_IDS - n_held))))
                held.append((batch.column("doc")[run + at : run + end], ids[ends[at] : ends[end]], sizes[at:end]))
                n_held += int(ends[end] - ends[at])
                at = end
                if n_held >= BLOCK_IDS:
                    yield flush()
    if held:
        yield flush()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them in ascending id order, each with end_id after it.

    A null text is empty: its ids are the end id alone. Rows that repeat an id stand
    side by side, in any order, and null ids come first. An empty table writes no
    blocks. Other columns are ignored.

    Texts are dealt into ranges and sorted before they are encoded: compressed, they are
    no larger than their ids.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    width = width_of(max(vocabulary, end_id + 1))
    ranged = rows.repartitionByRange(F.asc_nulls_first("doc")).sortWithinPartitions(F.asc_nulls_first("doc"))
    ranged.mapInArrow(lambda it: _blocks(it, tokenizer, width, end_id), FORMAT).write.parquet(out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(path)


def positions(blocks: DataFrame) -> DataFrame:
    """shard, offset: ids in all shards before. A row per shard, however many blocks."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    return sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("offset"))


def _documents(batches):
    for batch in batches:
        for base, width, n, n_null, docs, starts, payload in zip(*[batch.column(c).to_pylist() for c in ("base", "width", "n_ids", "n_null", "docs", "starts", "payload")], strict=True):
            flat, starts, docs = unpack(payload, width, n).astype("<u4"), np.frombuffer(starts, "<i8"), np.frombuffer(docs, "<i8")
            ends = np.append(starts[1:], n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.arange(len(docs)) < n_null), pa.array(base + starts), pa.array(ends - starts), binary_array(flat.view(np.uint8), 4 * np.append(starts, n))], names=["doc", "start", "n_tokens", "ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc, start (ids before it in the corpus), n_tokens, ids (little-endian unsigned 32-bit bytes)."""
    blocks = read_blocks(spark, path)
    # a shard is a task of the write, of which there are spark.sql.shuffle.partitions at most
    placed = blocks.join(F.broadcast(positions(blocks)), "shard").withColumn("base", F.col("offset") + F.col("first"))
    return placed.select("base", "width", "n_ids", "n_null", "docs", "starts", "payload").mapInArrow(_documents, "doc long, start long, n_tokens long, ids binary")


def read_span(spark: SparkSession, path: str, doc: int, start: int, n: int) -> np.ndarray:
    """n ids of one document from its start-th on: random access to one block."""
    row = read_blocks(spark, path).where((F.col("min_doc") <= doc) & (F.col("max_doc") >= doc)).where(F.expr("n_ids > 0")).orderBy("shard", "block").limit(1).collect()
    for r in row:
        ids, starts = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["starts"], "<i8")
        i = r["n_null"] + int(np.searchsorted(ids[r["n_null"] :], doc))
        if i < len(ids) and ids[i] == doc:
            end = starts[i + 1] if i + 1 < len(ids) else r["n_ids"]
            return unpack(r["payload"], r["width"], int(min(n, end - starts[i] - start)), int(starts[i] + start))
    return np.zeros(0, np.uint64)
