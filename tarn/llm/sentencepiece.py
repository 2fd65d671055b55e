"""SentencePiece encoding and decoding, with giant texts as a parallel scan of chunks.

A text of up to GIANT characters is one chunk. A giant one is cut every GIANT
characters, wherever that falls: its chunks yield their transfer matrices in any task,
the matrices (small, whatever the chunk's size) are scanned per text, and each chunk is
then backtraced on its own between the states that the scan chose.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, written
from tarn.llm.pieces import SPACE, coder, pieces, reader, scan
from tarn.llm.tokens import binary_array, text_runs

GIANT = 1 << 16
RUN = 2_000_000  # bytes of short texts coded at a time
EDGE = 64  # characters of a chunk's neighbours that it sees: more than two pieces' length


def _chunked(frames, path: str, size: int):
    """Chunks of marked texts, each with its neighbours' edges: lead says how many characters before it are shown.

    Runs of spaces are one space each; runs and counts say where they were and how long.
    """
    model = pieces(path)
    for frame in frames:
        for row, text in zip(frame["row"], frame["text"], strict=True):
            marked, runs = model.collapsed(SPACE + text.replace(" ", SPACE))
            places, counts = np.array([*runs.keys()], "<i8"), np.array([*runs.values()], "<i8")
            for part, at in enumerate(range(0, len(marked), size)):
                low, high = at - min(EDGE, at), at + size + EDGE
                a, b = np.searchsorted(places, [low, high])
                yield pd.DataFrame([{"row": row, "part": part, "lead": at - low, "size": min(size, len(marked) - at), "text": marked[low:high], "runs": (places[a:b] - low).tobytes(), "counts": counts[a:b].tobytes()}])


def _starts(model, text: str, part: int, lead: int):
    return model.states(text, lead) if part else None


def _matrices(frames, path: str):
    model = pieces(path)
    for frame in frames:
        out = []
        for r in frame.itertuples():
            m, _ = model.transfer(r.text, _starts(model, r.text, r.part, r.lead), r.lead + r.size)
            out.append((r.row, r.part, m.shape[0], m.shape[1], m.tobytes()))
        yield pd.DataFrame(out, columns=["row", "part", "n", "m", "matrix"])


def _scanned(group: pd.DataFrame) -> pd.DataFrame:
    """The state at each cut: the one whose path so far and path onward are best together."""
    group = group.sort_values("part")
    matrices = [np.frombuffer(x).reshape(n, m) for x, n, m in zip(group["matrix"], group["n"], group["m"], strict=True)]
    forward = [m[0] for m in scan(matrices)]
    backward = scan([m.T for m in reversed(matrices)])[::-1]
    ends = [int(np.argmax(f + b[0])) for f, b in zip(forward, [*backward[1:], np.zeros((1, matrices[-1].shape[1]))], strict=True)]
    return pd.DataFrame({"row": group["row"], "part": group["part"], "begin": [0, *ends[:-1]], "end": ends})


def _backtraced(frames, path: str):
    model = pieces(path)
    for frame in frames:
        out = []
        for r in frame.itertuples():
            cut = r.lead + r.size
            starts = _starts(model, r.text, r.part, r.lead)
            a, b = starts[r.begin] if starts else (0, 0)
            ends = model.states(r.text, cut) if cut < len(r.text) else [(len(r.text), len(r.text))]
            s, e = ends[r.end]
            parts: list[str] = []
            if (s, e) != (a, b) and e > b:
                last, _ = model.forward(r.text, b, r.text[a:b], e)
                runs = dict(zip(np.frombuffer(r.runs, "<i8").tolist(), np.frombuffer(r.counts, "<i8").tolist(), strict=True))
                parts = model.expanded(model.path(last, b, e), runs, b)
            out.append((r.row, r.part, np.array(model.numbers(parts), "<u4").tobytes()))
        yield pd.DataFrame(out, columns=["row", "part", "ids"])


def encode(docs: DataFrame, model_path: str, text_col: str = "text", giant: int = GIANT) -> DataFrame:
    """docs with n_tokens and ids (little-endian unsigned 32-bit bytes), as the model's own library gives them.

    A null or empty text has no ids. All other columns and all rows stay, whatever their
    names; columns named n_tokens or ids are replaced. An empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    own = F.struct(*[F.col(f"`{c}`") for c in names]).alias("own")  # a table's own columns travel apart from what is added
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    @F.arrow_udf("binary")
    def one_chunk(texts: pa.Array) -> pa.Array:
        model, out = coder(model_path), []
        for _, raw, offsets in text_runs(texts, RUN):
            ids, sizes = model.encode_texts(raw, offsets)
            out.append(binary_array(ids.view(np.uint8), np.append(0, np.cumsum(4 * sizes))))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    in_chunks = F.length(text) > giant
    plain = docs.where(~in_chunks).select(own, one_chunk(text).alias("ids"))
    rows = written(docs.where(in_chunks).select(own, text.alias("text"), F.monotonically_increasing_id().alias("row")), "texts")
    n_chunks = rows.agg(F.coalesce(F.sum(F.ceil(F.length("text") / giant)), F.lit(0))).first()[0]
    chunks = rows.select("row", "text").mapInPandas(lambda it: _chunked(it, model_path, giant), "row long, part int, lead int, size int, text string, runs binary, counts binary")
    chunks = written(chunks.repartition(n_chunks // 4 + 1, "row", "part"), "chunks")
    matrices = chunks.mapInPandas(lambda it: _matrices(it, model_path), "row long, part int, n int, m int, matrix binary")
    states = matrices.groupBy("row").applyInPandas(_scanned, "row long, part int, begin int, end int")
    traced = chunks.join(states, ["row", "part"]).mapInPandas(lambda it: _backtraced(it, model_path), "row long, part int, ids binary")
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("part", "ids"))), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    giants = rows.select("own", "row").join(traced.groupBy("row").agg(joined.alias("ids")), "row").select("own", "ids")
    out = plain.unionByName(giants)
    return out.select(*[F.col("own").getField(c).alias(c) for c in names], (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids", carried: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) with decoded, the text of the ids.

    Null ids have an empty text; a carried column named decoded is replaced. An empty
    table gives an empty result.
    """

    small_batches(coded.sparkSession)

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        model = reader(model_path)
        return pd.Series([model.decode(np.frombuffer(x or b"", "<u4")) for x in ids], dtype=object)

    return coded.select(*[F.col(f"`{c}`") for c in carried or coded.columns if c != "decoded"], text_of(F.col(f"`{ids_col}`")).alias("decoded"))
