"""Spelling variants: words that differ in one character, found by hashes of their deletions.

1. Runs of letters are counted, and counts added up before they are shuffled.
2. Each word yields an integer key for itself and for each way to delete a character. Keys
   are polynomial hashes: of what stands before the character and of what stands after it,
   which running sums give for all words of a batch at once.
3. Keys are dealt by their leading bits, and sorted in each part. Keys of one word go; the
   others fetch their words, and are verified on the strings that the deletions leave.
4. Words that leave the same string by a deletion at the same place differ by a replaced
   character; one that leaves another word differs from it by an inserted one. Each near
   pair has exactly one such string and place, so near words are counted, and the most
   frequent found, from the sizes and the two first of each group: no pair becomes a row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import mix64, small_batches, written

RUN = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_TIMES = 7, 2
OFTEN = 10  # so many times as often as a word is the one that it is a form of
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)
PART = 1 << 16  # keys in a part, about
_ENTRY = "key long, id long, place int, first boolean"


def misspelt(run: bytes, seed: int, every: int) -> bytes:
    """A run, lower-cased; of one in every, by the checksum of seed's text and the run, a character is deleted."""
    h = zlib.crc32(run, seed)
    if h % every:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _counted(batches, pattern: re.Pattern, least: int, every: int | None):
    for batch in batches:
        total: Counter = Counter()
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own: Counter = Counter()
            for run, n in Counter(pattern.findall(text)).items():
                own[run.encode().lower()] += n  # of bytes, lower() changes A-Z only
            if every:
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in own.items():
                    total[misspelt(run, seed, every)] += n
            else:
                total.update(own)
        words = [w.decode() for w in total]
        long = [i for i, w in enumerate(words) if len(w) >= least]
        times = [*total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in long], pa.string()), pa.array([times[i] for i in long], pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, every: int | None = None) -> DataFrame:
    """word, n: how often each run of at least so many letters occurs; A-Z are lower-cased. With every, some are misspelt first."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[f"`{id_col}`"].alias("doc"), docs[f"`{text_col}`"].alias("text")).where("text IS NOT NULL")
    pattern = re.compile(f"[{RUN}]{{{least},}}")
    return rows.mapInArrow(lambda it: _counted(it, pattern, least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, which word, place and first of all words' entries. place is the deleted character's, -1 where none is; first says that no equal character stands before it."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    which = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - starts[which]
    power = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    power[1:] = BASE
    with np.errstate(over="ignore"):
        power = np.cumprod(power, dtype=np.uint64)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat * power[place], out=sums[1:])
        at = np.arange(len(flat))
        before, after = sums[at] - sums[starts[which]], sums[ends[which]] - sums[at + 1]
        cut, whole = before + after * np.uint64(INVERSE), sums[ends] - sums[starts]
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (place[1:] == 0)
    n = len(words)
    return mix64(np.concatenate([whole, cut])).view(np.int64), np.concatenate([np.arange(n), which]), np.concatenate([np.full(n, -1), place]), np.concatenate([np.ones(n, bool), first])


def _keys(batches):
    for batch in batches:
        ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
        begin, size = 0, 0
        for end, w in enumerate(words, 1):
            size += len(w) + 1
            if size >= 1 << 18 or end == len(words):
                key, which, place, first = deletion_keys(words[begin:end])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[begin:end][which]), pa.array(place.astype(np.int32)), pa.array(first)], names=["key", "id", "place", "first"])
                begin, size = end, 0


def _shared(part: pa.Table) -> pa.Table:
    """The entries of keys that several words have, in order of keys."""
    key, ids = part.column("key").to_numpy(), part.column("id").to_numpy()
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(key)))
    several = np.repeat(ids[heads] != ids[heads + sizes - 1], sizes) if len(key) else np.zeros(0, bool)
    return part.select(["key", "id", "place", "first"]).take(pa.array(order[several]))


def _others_best(group: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member: how many others its group has, and the first of them by n, then by rank (-1: none)."""
    order = np.lexsort((rank, -n, group))
    heads = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    sizes = np.diff(np.append(heads, len(order)))
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    best = np.where(np.arange(len(order)) != head, order[head], np.where(size > 1, order[np.minimum(head + 1, len(order) - 1)], -1))
    others, out = np.zeros(len(order), np.int64), np.full(len(order), -1)
    others[order], out[order] = size - 1, best
    return others, out


def _near(part: pa.Table) -> pa.Table:
    """id, near, best_n, best: what each verified group says of its members."""
    words, place, first = part.column("word").to_pylist(), part.column("place").to_numpy(), part.column("first").to_numpy()
    ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
    found: list[tuple] = []
    if len(words):
        left = np.array([w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(words, place.tolist(), strict=True)], object)
        _, string = np.unique(left, return_inverse=True)
        _, rank = np.unique(np.array(words, object), return_inverse=True)
        cut = np.flatnonzero(place >= 0)
        _, group = np.unique(np.stack([string[cut], place[cut]], axis=1), axis=0, return_inverse=True)
        others, best = _others_best(group.ravel(), n[cut], rank[cut])
        found.append((cut, others, np.where(best >= 0, cut[best], -1)))
        # a word that a deletion leaves: it and the words that leave it
        whole = np.full(string.max() + 1, -1)
        whole[string[place < 0]] = np.flatnonzero(place < 0)
        longer = np.flatnonzero((place >= 0) & first & (whole[string] >= 0))
        found.append((longer, np.ones(len(longer), np.int64), whole[string[longer]]))
        if len(longer):
            order = longer[np.lexsort((rank[longer], -n[longer], string[longer]))]
            heads = np.flatnonzero(np.append(True, string[order][1:] != string[order][:-1]))
            found.append((whole[string[order[heads]]], np.diff(np.append(heads, len(order))), order[heads]))
    at, near, best = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    some = near > 0
    at, near, best = at[some], near[some], best[some]
    return pa.table({"id": pa.array(ids[at], pa.int64()), "near": pa.array(near, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array([words[b] for b in best.tolist()], pa.string())})


def near_words(counts: DataFrame, least_times: int = LEAST_TIMES, part: int = PART) -> DataFrame:
    """word, n, n_near, best, best_n: the words that occur so often, how many of them are near, and the most frequent of those."""
    vocabulary = written(counts.where(F.col("n") >= least_times).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    bits = max(1, int(size // part).bit_length())
    radix = F.shiftrightunsigned("key", 64 - bits).alias("radix")
    entries = vocabulary.select("id", "word").mapInArrow(_keys, _ENTRY)
    shared = written(entries.groupBy(radix).applyInArrow(_shared, _ENTRY), "shared")
    named = shared.join(vocabulary, "id").select("key", "id", "place", "first", "word", "n")
    said = named.groupBy(radix).applyInArrow(_near, "id long, near long, best_n long, best string")
    best = said.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return vocabulary.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root for forms (word, form): where the forms of forms end. Each step is to a more frequent word, so they do.

    A pass doubles how far each word sees.
    """
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        seen = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = seen.select("word", "root")
        if not seen.where("moved").limit(1).count():
            return roots


def variants(counts: DataFrame, least_times: int = LEAST_TIMES, often: int = OFTEN, part: int = PART) -> DataFrame:
    """One row per word that occurs so often: word, form, root, n, n_near, form_n. counts: word, n.

    Near words differ by one inserted, deleted or replaced character. A word's form is its
    most frequent near word (ties: the first in code-point order) if that occurs at least
    often times as often; else it is null, and root is the word itself. Words may be of any
    length; rows with a null word or count take no part; an empty table gives an empty result.
    """
    near = written(near_words(counts.where("word IS NOT NULL").select("word", "n"), least_times, part), "near")
    is_form = F.col("best_n") >= often * F.col("n")
    found = near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    roots = rooted(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
