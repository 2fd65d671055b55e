"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles. Equal sets are one class, known
   by two 64-bit sums over the set, and only classes go on.
2. A class's signature has BANDS * ROWS minima; classes that share all rows of a band
   share a bucket. The class of a bucket that
   meets most others in all its buckets is paired with the bucket's other members.
3. Signatures of paired classes are compared batch by batch. After each batch, the pair
   goes if the posterior probability of a similarity of at least the threshold, given the
   matches so far, is below the chosen miss probability.
4. Survivors are verified on full shingle sets, first each class's likeliest pair only.
5. Where a bucket still holds several components, its members outside the largest one
   meet all others, block by block inside tasks, by longer signatures; only pairs that
   survive become rows. No pair across components goes unjudged, and none inside a
   component is made.

Two classes at the threshold share no bucket with probability
(1 - threshold**ROWS)**BANDS, 3e-6 at 0.8.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import BROADCAST_IDS, mix64, small_batches, without_dropped, written
from tarn.llm.components import connected_components
from tarn.llm.tokens import text_runs
from tarn.llm.words import ngrams, word_hashes

BANDS, ROWS = 32, 5
FINE = 1024  # places of the longer signatures
BLOCK_OUTSIDE, BLOCK_ALL = 2048, 4096
BATCH = 16  # signature places compared at a time
_seed = np.arange(1, FINE + 1, dtype=np.uint64)
FLIP, FACTOR = (mix64(_seed) >> np.uint64(32)).astype(np.uint32), (mix64(_seed + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SKETCH = "n long, key binary, sig binary, bands array<long>"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int):
    """For each text raw[offsets[i]:offsets[i + 1]]: the sorted distinct hashes of its word shingles; with fewer words, of the whole sequence."""
    hashes, counts = word_hashes(raw, offsets)
    full, at = ngrams(hashes, size), 0
    for n in counts.tolist():
        yield np.unique(full[at : at + n - size + 1]) if n >= size else ngrams(hashes[at : at + n], n) if n else np.zeros(0, np.uint64)
        at += n


def shingles(text: str | None, size: int) -> np.ndarray:
    """The shingle set of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return next(shingle_sets(raw, np.array([0, len(raw)]), size))


def signature(hashes: np.ndarray, places: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of each of the multiply-xor orders of the set, in blocks of bounded size."""
    low, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(places, 0xFFFFFFFF, np.uint32)
    flip, factor = FLIP[:places, None], FACTOR[:places, None]
    for i in range(0, len(low), 2048):
        out = np.minimum(out, ((low[i : i + 2048] ^ flip) * factor).min(axis=1))
    return out


def _sketch(found: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Of a set of shingles: its key, eight bits of each place of its signature, and its buckets by band."""
    if not len(found):
        return b"", b"", np.zeros(0, np.int64)
    sums = np.array([mix64(found).sum(dtype=np.uint64), mix64(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)], "<u8")
    sig = signature(found)
    bands = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        bands = mix64(bands ^ column) + column
    return sums.tobytes(), (sig & np.uint32(0xFF)).astype(np.uint8).tobytes(), bands.view(np.int64)


@lru_cache
def fewest_matches(threshold: float, miss: float, places: int = BANDS * ROWS, batch: int = BATCH) -> np.ndarray:
    """After each batch: the matches below which a pair goes. Prior: any similarity alike."""
    similarity = np.linspace(0, 1, 2001)
    equal = similarity + (1 - similarity) / 256  # signatures hold eight bits of each minimum
    out = []
    least = 0
    for n in range(batch, places + 1, batch):
        for m in range(least, n + 1):
            with np.errstate(divide="ignore"):
                log = m * np.log(equal) + (n - m) * np.log1p(-np.minimum(equal, 1 - 1e-12))
            weight = np.exp(log - log.max())
            if weight[similarity >= threshold - 1e-9].sum() >= miss * weight.sum():
                break
        out.append(m)
        least = m  # it only rises
    return np.array(out)


def _compare(frames, threshold: float, miss: float):
    """Pairs that survive all batches, with the matches of their whole signatures."""
    fewest = fewest_matches(threshold, miss)
    for frame in frames:
        if not len(frame):
            continue
        one, two = (np.frombuffer(b"".join(frame[c]), np.uint8).reshape(len(frame), -1) for c in ("sig_a", "sig_b"))
        alive, matches = np.arange(len(frame)), np.zeros(len(frame), np.int64)
        for i, least in enumerate(fewest):
            part = slice(i * BATCH, (i + 1) * BATCH)
            matches[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        yield pd.DataFrame({"a": frame["a"].to_numpy()[alive], "b": frame["b"].to_numpy()[alive], "matches": matches[alive]})


def _across(group: pd.DataFrame, threshold: float, miss: float, percent: int) -> pd.DataFrame:
    """A block of a bucket's outside members against a block of all: the pairs across components that survive.

    A pair that shares several buckets counts in the first band that it shares.
    """
    fewest, batch = fewest_matches(threshold, miss, FINE, 64), 64
    ours, all_ = group[group["role"] == 0], group[group["role"] == 1]
    out: list[np.ndarray] = []
    if len(ours) and len(all_):
        bucket = group["bucket"].iloc[0]
        sig, other = (np.frombuffer(b"".join(x["fine"]), np.uint8).reshape(-1, FINE) for x in (ours, all_))
        node, nodes = ours["node"].to_numpy(), all_["node"].to_numpy()
        bands, others = np.stack(ours["bands"].to_numpy()), np.stack(all_["bands"].to_numpy())
        n, ns, c, cs, outside = ours["n"].to_numpy(), all_["n"].to_numpy(), ours["component"].to_numpy(), all_["component"].to_numpy(), all_["outside"].to_numpy()
        for i in range(len(ours)):
            fits = (cs != c[i]) & (~outside | (nodes > node[i])) & (100 * np.minimum(ns, n[i]) >= percent * np.maximum(ns, n[i]))
            j = np.flatnonzero(fits)
            if len(j):
                j = j[others[j, (others[j] == bands[i]).argmax(axis=1)] == bucket]
            matches = np.zeros(len(j), np.int64)
            for k, least in enumerate(fewest):
                part = slice(k * batch, (k + 1) * batch)
                matches += (other[j, part] == sig[i, part]).sum(axis=1)
                alive = matches >= least
                j, matches = j[alive], matches[alive]
                if not len(j):
                    break
            out.append(np.stack([np.minimum(nodes[j], node[i]), np.maximum(nodes[j], node[i])], axis=1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _verify(frames, size: int, percent: int):
    for frame in frames:
        sets: dict[int, np.ndarray] = {}
        linked = []
        for a, b, one, two in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"], strict=True):
            if len(sets) > 64:
                sets.clear()
            for k, t in ((a, one), (b, two)):
                if k not in sets:
                    sets[k] = shingles(t, size)
            x, y = sets[a], sets[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": np.array(linked, bool)})


class _Search:
    def __init__(self, texts: DataFrame, classes: DataFrame, size: int, percent: int, miss: float):
        self.texts, self.classes, self.size, self.percent, self.miss = texts, classes, size, percent, miss

    def survivors(self, pairs: DataFrame) -> DataFrame:
        """a, b, matches of the pairs that sequential comparison keeps; sizes alone rule out some."""
        for side in "ab":
            own = self.classes.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n").alias(f"n_{side}"))
            pairs = pairs.join(own, side)
        pairs = pairs.where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")
        threshold, miss = self.percent / 100, self.miss
        return written(pairs.mapInPandas(lambda it: _compare(it, threshold, miss), "a long, b long, matches long"), "survivors")

    def _texts_of(self, nodes: DataFrame) -> DataFrame:
        nodes = nodes.distinct()
        nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
        return self.texts.join(nodes, "row", "left_semi").select("row", "text")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked: judged on full shingle sets."""
        texts = written(self._texts_of(pairs.select(F.col("a").alias("row")).union(pairs.select("b"))), "texts")
        for side in "ab":
            pairs = pairs.join(texts.select(F.col("row").alias(side), F.col("text").alias(f"text_{side}")).hint("merge"), side)
        size, percent = self.size, self.percent
        return written(pairs.select("a", "b", "text_a", "text_b").mapInPandas(lambda it: _verify(it, size, percent), "a long, b long, linked boolean"), "verified")

    def across(self, rows: DataFrame) -> DataFrame:
        """a, b: the surviving pairs between components. rows: bucket, node, outside (the bucket's largest component), component."""
        size, percent, threshold, miss = self.size, self.percent, self.percent / 100, self.miss

        def finer(frames):
            for frame in frames:
                for first, raw, offsets in text_runs(frame.column("text")):
                    fine = [(signature(x, FINE) & np.uint32(0xFF)).astype(np.uint8).tobytes() for x in shingle_sets(raw, offsets, size)]
                    yield pa.RecordBatch.from_arrays([frame.column("row")[first : first + len(fine)], pa.array(fine, pa.binary())], names=["node", "fine"])

        fine = self._texts_of(rows.select(F.col("node").alias("row"))).mapInArrow(finer, "node long, fine binary")
        fine = written(fine.join(self.classes.select("node", "n", "bands"), "node"), "fine")
        sizes = rows.groupBy("bucket").agg(F.count_if("outside").alias("_o"), F.count("*").alias("_a"))
        counted = rows.join(sizes, "bucket").withColumns({"_os": F.ceil(F.col("_o") / BLOCK_OUTSIDE).cast("int"), "_as": F.ceil(F.col("_a") / BLOCK_ALL).cast("int")})
        spread, other = F.xxhash64("node"), F.sequence(F.lit(0), F.col("_as") - 1)
        ours = counted.where("outside").withColumns({"o": F.pmod(spread, F.col("_os")).cast("int"), "m": F.explode(other), "role": F.lit(0)})
        all_ = counted.withColumns({"m": F.pmod(spread, F.col("_as")).cast("int"), "o": F.explode(F.sequence(F.lit(0), F.col("_os") - 1)), "role": F.lit(1)})
        names = ["bucket", "o", "m", "role", "node", "outside", "component"]
        blocks = ours.select(*names).unionByName(all_.select(*names)).join(fine, "node")
        found = blocks.groupBy("bucket", "o", "m").applyInPandas(lambda g: _across(g, threshold, miss, percent), "a long, b long")
        return written(found, "across")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Texts are linked when 100 * shared shingles >= percent * all shingles of both;
    component_id is the smallest id that links reach, its own included, and kept says
    that it is the row's own. A text without words has no shingles and no links; with
    fewer than shingle_words words, the sequence is the one shingle. Rows that repeat an
    id and a text are all kept or all dropped. Null ids are never the smallest of a
    group with others; a group of null ids has a null component_id, and all its rows
    stay. An empty table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), "texts")
    sketches = written(_sketches(numbered, shingle_words), "sketches")
    groups = sketches.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc").alias("doc"))
    groups = written(groups, "groups")
    classes = written(sketches.drop("key", "doc").join(groups.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node"), "classes")
    search = _Search(numbered, classes, shingle_words, percent, miss)

    entries = classes.select("node", F.explode("bands").alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(entries.join(crowded, "bucket"), "buckets")
    # the member that meets most others stands nearest to the middle of its group
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    leaders = shared.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("top")).select("bucket", (-F.col("top.node")).alias("leader"))
    pairs = shared.join(leaders, "bucket").where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = search.survivors(pairs)
    likeliest = first.groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    judged = search.verified(likeliest)
    links = judged.where("linked").select("a", "b")
    components = written(connected_components(links), "components")

    labelled = shared.select("bucket", "node").join(components, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    open_buckets = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("top.component").alias("top"))
    open_rows = written(labelled.join(open_buckets, "bucket"), "open")
    second = search.verified(search.across(open_rows.select("bucket", "node", (F.col("component") != F.col("top")).alias("outside"), "component")))
    second_links = second.where("linked").select("a", "b")
    if second_links.limit(1).count():
        components = written(connected_components(links.unionByName(second_links)), "components")

    named = groups.join(components, "node", "left").select("key", "doc", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("least"))
    final = named.join(smallest, "component").select("key", "least")
    out = sketches.select("key", "doc", "n").join(final, "key", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def _sketches(numbered: DataFrame, size: int) -> DataFrame:
    def sketch(batches):
        for batch in batches:
            for first, raw, offsets in text_runs(batch.column("text")):
                sets = [(len(x), *_sketch(x)) for x in shingle_sets(raw, offsets, size)]
                n, key, sig, bands = zip(*sets, strict=True)
                own = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), own.column("doc"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["row", "doc", "n", "key", "sig", "bands"],
                )

    return numbered.select("row", "doc", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sketch, f"row long, doc long, {SKETCH}")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns: one id of each group.

    Rows are kept by id, so rows that share an id should share a text. Rows without an
    id or without words stay. Other columns may have any names; an empty table gives an
    empty result.
    """
    return without_dropped(docs, near_duplicates(docs, id_col, text_col, **options), id_col)
