"""SimHash near-dedup by deletion-variant signatures.

1. Each text becomes a 64-bit fingerprint: the majority, bit by bit, of the XXH64 of its
   word shingles. Equal fingerprints are one code, and only codes go on.
2. A fingerprint is cut into two segments of 32 bits. Two codes that differ in at most two
   bits differ in at most one bit of one segment. A segment is indexed by itself and by its
   variants with one bit deleted; codes of an equal key, on either side of its deleted bit,
   meet in an equality join and are verified on all 64 bits.
3. A key of more than CROWD codes would make too many pairs. Its codes get a second key each
   for every way to delete what may still differ in the other segment: codes that share
   both are near as they stand, so the first of them is linked with the rest. That work
   grows with the codes, not with their pairs.
4. Links make components; each document's is named by its smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, written
from tarn.llm.components import connected_components
from tarn.llm.tokens import text_runs
from tarn.llm.words import _LOWER, _WORD, spans

SEED = 42
CROWD = 64  # codes of a key that meet by pairs
AT_ONCE = 1 << 18  # shingles hashed at a time
# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_lanes = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]  # a byte's bits, a byte each


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each raw[starts[i]:ends[i]], all at once: stripes of 32 bytes, then words of eight and four, then bytes."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight, four = (np.ndarray((len(raw) + 1,), kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    at, left, seed = starts.astype(np.int64), (ends - starts).astype(np.int64), np.uint64(seed)
    with np.errstate(over="ignore"):
        out = np.full(len(at), seed + P5, np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            own = [np.full(len(long), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            go = np.arange(len(long))
            while len(go):
                i = long[go]
                for k in range(4):
                    own[k][go] = _turned(own[k][go] + eight[at[i] + 8 * k] * P2, 31) * P1
                at[i] += 32
                left[i] -= 32
                go = go[left[i] >= 32]
            mixed = _turned(own[0], 1) + _turned(own[1], 7) + _turned(own[2], 12) + _turned(own[3], 18)
            for x in own:
                mixed = (mixed ^ (_turned(x * P2, 31) * P1)) * P1 + P4
            out[long] = mixed
        out += (ends - starts).astype(np.uint64)
        go = np.flatnonzero(left >= 8)
        while len(go):
            out[go] = _turned(out[go] ^ (_turned(eight[at[go]] * P2, 31) * P1), 27) * P1 + P4
            at[go] += 8
            left[go] -= 8
            go = go[left[go] >= 8]
        go = np.flatnonzero(left >= 4)
        out[go] = _turned(out[go] ^ (four[at[go]].astype(np.uint64) * P1), 23) * P2 + P3
        at[go] += 4
        left[go] -= 4
        go = np.flatnonzero(left)
        while len(go):
            out[go] = _turned(out[go] ^ (padded[at[go]].astype(np.uint64) * P5), 11) * P1
            at[go] += 1
            left[go] -= 1
            go = go[left[go] > 0]
        out = (out ^ (out >> np.uint64(33))) * P2
        out = (out ^ (out >> np.uint64(29))) * P3
        return out ^ (out >> np.uint64(32))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of so many hashes (one at least): the bits set in over half of them."""
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // 255)  # a byte counts up to 255
    head = np.cumsum(parts) - parts
    starts = np.repeat(first - 255 * head, parts) + 255 * np.arange(parts.sum())
    columns = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(sizes), 8), np.uint8)
    for k in range(8):
        counted = np.add.reduceat(_lanes[columns[:, k]], starts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(counted.astype(np.int64), head, axis=0)
        out[:, k] = np.packbits(2 * total > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8")[:, 0]


def fingerprints(raw: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text raw[offsets[i]:offsets[i + 1]]; zero for one without words."""
    starts, ends = spans(raw, offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    # words lower-cased, with one space after each: a shingle is a slice of this
    word = _WORD[raw]
    kept = word.copy()
    kept[ends[ends < len(raw)]] = True
    line = np.where(word, _LOWER[raw], np.uint8(32))[kept]
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    starts, ends = place[starts], place[ends]
    shingles = np.maximum(counts - size + 1, np.minimum(counts, 1))
    some = np.flatnonzero(shingles)
    sizes = shingles[some]
    begin = np.cumsum(sizes) - sizes
    first = np.repeat((np.cumsum(counts) - counts)[some] - begin, sizes) + np.arange(sizes.sum())
    last = first + np.repeat(np.minimum(counts[some], size), sizes) - 1
    hashes = np.zeros(len(first), np.uint64)
    for k in range(0, len(first), AT_ONCE):
        a, b = starts[first[k : k + AT_ONCE]], ends[last[k : k + AT_ONCE]]
        low = int(a.min())
        hashes[k : k + AT_ONCE] = xxh64(line[low : int(b.max())], a - low, b - low)
    out = np.zeros(len(counts), np.uint64)
    if len(some):
        out[some] = majority(hashes, sizes)
    return out


def _coded(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc, code: a row for each row of docs."""

    def codes(batches):
        for batch in batches:
            for first, raw, offsets in text_runs(batch.column("text")):
                found = fingerprints(raw, offsets, size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc")[first : first + len(found)], pa.array(found)], names=["doc", "code"])

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    return rows.mapInArrow(codes, "doc long, code long")


def _segment(which: int) -> Column:
    return F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)) if which == 0 else F.shiftrightunsigned("code", 32)


def _without(segment: Column, bit: Column) -> Column:
    return segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def variants(codes: DataFrame) -> DataFrame:
    """code, key, side: the 66 entries of each code.

    A key holds the segment, the deleted bit (32: none) and what is left, so equal keys are
    equal variants. side is the deleted bit's value, 2 where none is.
    """
    shift, right, one = (lambda x, by: F.call_function("shiftleft", x.cast("long"), by)), (lambda x, by: F.call_function("shiftrightunsigned", x, by)), F.lit(1).cast("long")

    def own(which: int) -> Column:
        segment = _segment(which)
        key = lambda bit, left: shift(bit + F.lit(33 * which), F.lit(32)).bitwiseOR(left)
        deleted = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(key(i, _without(segment, i)).alias("key"), right(segment, i).bitwiseAND(one).cast("int").alias("side")))
        return F.concat(deleted, F.array(F.struct(key(F.lit(32), segment).alias("key"), F.lit(2).alias("side"))))

    return codes.select("code", F.explode(F.concat(own(0), own(1))).alias("e")).select("code", "e.key", "e.side")


def near_codes(codes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links that join all distinct codes that differ in at most two bits.

    Every pair at that distance is joined by links, each of them between such a pair; where
    keys are crowded, not each pair is a row.
    """
    entries = variants(codes)
    ones = F.count_if(F.col("side") == 1)
    sizes = written(entries.groupBy("key").agg(F.count("*").alias("n"), ones.alias("ones"), F.max("side").alias("top")).where("(top = 2 AND n > 1) OR (top < 2 AND ones > 0 AND ones < n)").select("key", "n"), "keys")
    few = sizes.count() <= 1 << 20
    shared = written(entries.join(F.broadcast(sizes) if few else sizes, "key"), "shared")
    small = shared.where(F.col("n") <= crowd)
    one, two = small.where("side != 1").select("key", "side", F.col("code").alias("a")), small.where("side != 0").select("key", F.col("side").alias("other"), F.col("code").alias("b"))
    met = one.join(two, "key").where("(side = 0 AND other = 1) OR (side = 2 AND other = 2 AND a < b)").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")

    # what may still differ in the other segment: one bit beside the deleted one, two bits otherwise
    rest = F.when(F.shiftrightunsigned("key", 32) < 33, _segment(1)).otherwise(_segment(0))
    single = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("i"), i.alias("j")))
    double = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    crowded = shared.where(F.col("n") > crowd).select("key", "code", rest.alias("rest"), F.explode(F.when(F.col("side") == 2, double).otherwise(single)).alias("cut"))
    second = crowded.groupBy("key", "cut", _without(_without(F.col("rest"), F.col("cut.i")), F.col("cut.j")).alias("left")).agg(F.collect_list("code").alias("codes"))  # four codes at most share both keys
    starred = second.where(F.size("codes") > 1).select(F.array_min("codes").alias("a"), F.explode("codes").alias("b")).where("a != b").distinct()
    return met.unionByName(starred)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: id_col, fingerprint, component_id, kept.

    A fingerprint (16 hex digits) has a bit set where over half of the text's shingles,
    repeats counted, have it in their XXH64 (seed 42). A text with fewer than shingle_words
    words has one shingle, its whole sequence; one without words, or null, has the
    fingerprint zero and is linked like any other. Fingerprints that differ in two bits or
    fewer are linked; component_id is the smallest id that links reach, its own included,
    and kept says that it is the row's own. Rows may repeat ids and texts. Null ids are
    never the smallest of a group with others; a group of null ids has a null
    component_id, and all its rows stay. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    coded = written(_coded(docs, id_col, text_col, shingle_words), "fingerprints")
    codes = written(coded.groupBy("code").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "codes")
    components = written(connected_components(near_codes(codes.select("code"), crowd)), "components")
    linked = codes.join(components, F.col("code") == F.col("node"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    changed = linked.join(smallest, "component").select("code", "smallest")
    # a code of one row without links is its own component; only the others travel to the rows
    shared = written(codes.join(changed, "code", "left").where("n > 1 OR smallest IS NOT NULL").select("code", F.coalesce("smallest", "least").alias("component_id"), F.lit(True).alias("found")), "named")
    out = coded.join(F.broadcast(shared) if shared.count() <= 1 << 20 else shared, "code", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
