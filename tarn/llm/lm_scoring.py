"""Language-model scores by a weighted backoff automaton over the corpus's n-grams.

The model is an n-gram model with Dirichlet smoothing: after history h, a word w has
probability (c(hw) + strength * p(w | shorter h)) / (c(h) + strength), and the base is
(c(w) + 1) / (N + V + 1). As an automaton:

- Each history that training has seen is a state; the root has none.
- A state has an arc for every word seen after it, with the word's log probability, to
  the state of the longest history that the word then ends. The root has an arc for
  every word.
- Every other state has a failure arc, with weight log10(strength / (c(h) + strength)),
  to the state of the shorter history.

A text is read once from left to right. The traversal carries the state: while it has
no arc for the word, the failure arc is taken; then the arc. Weights add up to the
text's log probability.

No task and no broadcast ever holds the model. Documents are gathered in batches of
bounded size, and each batch needs the part of the automaton that its own n-grams reach:

1. A batch sends each owner of a hash range its sorted distinct n-gram fingerprints in
   that range, Golomb-coded, with their counts in the batch's training documents.
2. An owner adds up the counts, and answers each batch with the totals of its n-grams.
3. The batch builds its part of the automaton from the totals and traverses it.

Both exchanges hold an n-gram once a batch, however often it occurs, and grow with the
corpus. An owner's range holds OWNER_NGRAMS or so. Beyond SMALL bytes of text, batches
grow with the square root of the corpus, so that messages keep their size.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tarn.llm import golomb
from tarn.llm.common import owners, small_batches, written
from tarn.llm.tokens import text_runs
from tarn.llm.words import ngrams, word_hashes

BATCH_BYTES = 4_000_000  # of text, up to SMALL bytes of corpus; one longer document is a batch of its own
SMALL = 200_000_000_000
OWNER_NGRAMS = 1_500_000
SLACK = 22  # bits of an n-gram's fingerprint over those that number the corpus: two share one once in 4 million
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # hashes of the end of a text and of what stands before it
TRAIN, WORD = np.uint64(1), np.uint64(2)  # lowest bits of a key: from a training document; a word, not a longer n-gram
KEY = ~np.uint64(3)
HOME = "batch long, ids binary, nulls binary, train binary, sizes binary, texts binary, trained long"
ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in HOME.split(", "))])


def _batches(frames, batch_bytes: int):
    """Documents gathered to rows of about batch_bytes."""
    part, turn = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def flush():
        ids, nulls, train, raw, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        words = word_hashes(raw, np.append(0, np.cumsum(sizes)))[1]
        return pa.RecordBatch.from_pylist([{
            "batch": (part << 32) | turn, "ids": ids.astype("<i8").tobytes(), "nulls": nulls.astype(np.uint8).tobytes(), "train": train.astype(np.uint8).tobytes(),
            "sizes": sizes.astype("<i8").tobytes(), "texts": zstandard.ZstdCompressor(level=3).compress(raw.tobytes()), "trained": int((words + 1)[train].sum()),
        }], ARROW)

    for frame in frames:
        doc, train = frame.column("doc"), np.asarray(frame.column("train"))
        nulls, doc = np.asarray(doc.is_null()), doc.fill_null(0).to_numpy()
        for first, raw, offsets in text_runs(frame.column("text"), batch_bytes // 4):
            own = slice(first, first + len(offsets) - 1)
            if held and size + len(raw) > batch_bytes:
                yield flush()
                held, size, turn = [], 0, turn + 1
            held.append((doc[own], nulls[own], train[own], raw.copy(), np.diff(offsets)))
            size += len(raw)
    if held:
        yield flush()


class Grams:
    """A batch's n-grams by position: its words with BEGIN and END around each document.

    keys[n - 1]: keys of the n-grams that end at each position; inside[n - 1]: where one
    lies within a document. BEGIN is a history but never a word.
    """

    def __init__(self, row, order: int, bits: int):
        sizes = np.frombuffer(row.sizes, "<i8")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.texts, max_output_size=int(sizes.sum()) + 1), np.uint8)
        hashes, counts = word_hashes(raw, np.append(0, np.cumsum(sizes)))
        self.sizes = counts + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        ends = self.starts + counts + 1
        tokens, word = np.empty(int(self.sizes.sum()), np.uint64), np.ones(int(self.sizes.sum()), bool)
        word[self.starts] = word[ends] = False
        tokens[self.starts], tokens[ends], tokens[word] = BEGIN, END, hashes
        self.train = np.frombuffer(row.train, np.uint8).astype(bool)
        word[ends] = True  # the end counts as a word, what stands before a text does not
        place = np.arange(len(tokens)) - np.repeat(self.starts, self.sizes)
        coarse = ~np.uint64((1 << (64 - bits)) - 1)  # the lowest bits of a key are marks
        self.keys, self.inside = [], []
        for n in range(1, order + 1):
            own = np.zeros(len(tokens), np.uint64)
            own[n - 1 :] = ngrams(tokens, n)
            self.keys.append(np.where(word, (own & KEY) | WORD, own & coarse) if n == 1 else own & coarse)
            self.inside.append(place >= n - 1)

    def all_keys(self) -> np.ndarray:
        return np.concatenate([k[i] for k, i in zip(self.keys, self.inside, strict=True)])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and how often each occurs in training documents."""
        used = np.repeat(self.train, self.sizes)
        marked = np.sort(self.all_keys() | np.concatenate([used[i] for i in self.inside]).astype(np.uint64))
        keys = marked & ~TRAIN
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.append(0, np.cumsum((marked & TRAIN).astype(np.int64)))
        return keys[edge], np.diff(total[np.append(edge, len(keys))])

    def by_length(self, slot: np.ndarray, totals: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """slot: where each of all_keys() stands in totals. Counts, and numbers by position, of each length's own n-grams."""
        counts, slots, at = [], [], 0
        for inside in self.inside:
            here = slot[at : at + int(inside.sum())]
            at += len(here)
            used = np.zeros(len(totals), bool)
            used[here] = True
            own = np.zeros(len(inside), np.int64)
            own[inside] = (np.cumsum(used) - 1)[here]
            counts.append(totals[used])
            slots.append(own)
        return counts, slots


_HEAD = struct.Struct("<IBIIBI")  # of the words and of the longer n-grams: how many, the code's parameter, the bytes of its quotients


def _lows(n_owners: int) -> list[int]:
    """Where each owner's range of keys begins."""
    return [(i << 64) // n_owners for i in range(n_owners)]


def _by_kind(distinct: np.ndarray, n_owners: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many of a batch's sorted keys each owner has; and of the words and of the longer n-grams, where they stand and where among them each owner's begin."""
    lows = np.array(_lows(n_owners), np.uint64)
    kinds = [(own, np.append(np.searchsorted(distinct[own], lows), len(own))) for own in (np.flatnonzero(distinct & WORD), np.flatnonzero((distinct & WORD) == 0))]
    return sum(np.diff(edges) for _, edges in kinds), kinds


def _in_turn(kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The order in which messages have a batch's sorted keys: each owner's words, then its longer n-grams."""
    (words, a), (longer, b) = kinds
    out = np.empty(len(words) + len(longer), np.int64)
    out[np.arange(len(words)) + np.repeat(b[:-1], np.diff(a))] = words
    out[np.arange(len(longer)) + np.repeat(a[1:], np.diff(b))] = longer
    return out


def _coded(distinct: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]], bits: int, n_owners: int) -> list[bytes]:
    """Each owner's keys: words by all bits, longer n-grams by the bits that their fingerprints have."""
    lows, parts = np.array(_lows(n_owners), np.uint64), []
    for (own, edges), drop in zip(kinds, (2, 64 - bits), strict=True):
        values = (distinct[own] >> np.uint64(drop)) - np.repeat(lows >> np.uint64(drop), np.diff(edges))
        k, codes = golomb.encode_runs(values, edges, 64 - drop - np.log2(n_owners))
        parts.append([(n, k, head, code) for n, (head, code) in zip(np.diff(edges).tolist(), codes, strict=True)])
    return [_HEAD.pack(*a[:3], *b[:3]) + a[3] + b[3] for a, b in zip(*parts, strict=True)]


def _decoded(codes: list[bytes], low: int, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of an owner's messages: all words' keys and all longer n-grams' keys, message after message; and how many of each every message has."""
    heads = np.array([_HEAD.unpack_from(c) for c in codes], np.int64).reshape(-1, 2, 3)
    cut = (_HEAD.size + heads[:, 0, 2] + (heads[:, 0, 0] * heads[:, 0, 1] + 7) // 8).tolist()
    parts = [c[_HEAD.size : at] for c, at in zip(codes, cut, strict=True)], [c[at:] for c, at in zip(codes, cut, strict=True)]
    keys = [
        ((golomb.decode_runs(*heads[:, i].T, parts[i]) + np.uint64(low >> drop)) << np.uint64(drop)) | mark
        for i, (drop, mark) in enumerate(((2, WORD), (64 - bits, np.uint64(0))))
    ]
    return keys, [heads[:, i, 0] for i in (0, 1)]


def _numbers(x: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Counts of each message, x[edges[i]:edges[i + 1]]; most are small: a byte each, and the rest apart."""
    large = np.flatnonzero(x >= 255)
    low, rest, at = np.minimum(x, 255).astype(np.uint8).tobytes(), x[large].astype("<i8").tobytes(), (np.searchsorted(large, edges) * 8).tolist()
    compress, edges = zstandard.ZstdCompressor(level=1).compress, edges.tolist()
    return [compress(low[a:b] + rest[c:d]) for a, b, c, d in zip(edges, edges[1:], at, at[1:], strict=False)]


def _read_numbers(codes, sizes: list[int]) -> np.ndarray:
    """All messages' counts, one after the other."""
    decompress = zstandard.ZstdDecompressor().decompress
    raw = [decompress(c) for c in codes]
    out = np.frombuffer(b"".join([r[:n] for r, n in zip(raw, sizes, strict=True)]), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(b"".join([r[n:] for r, n in zip(raw, sizes, strict=True)]), "<i8")
    return out


def _messages(frames, order: int, bits: int, n_owners: int):
    for frame in frames:
        for row in frame.itertuples():
            distinct, counts = Grams(row, order, bits).distinct()
            sizes, kinds = _by_kind(distinct, n_owners)
            codes, numbers = _coded(distinct, kinds, bits, n_owners), _numbers(counts[_in_turn(kinds)], np.append(0, np.cumsum(sizes)))
            own = np.flatnonzero(sizes).tolist()
            yield pd.DataFrame({"batch": row.batch, "owner": own, "n": sizes[own], "code": [codes[i] for i in own], "counts": [numbers[i] for i in own]})


def _totals(group: pd.DataFrame, bits: int, n_owners: int) -> pd.DataFrame:
    keys, (words, longer) = _decoded(group["code"].tolist(), (int(group["owner"].iloc[0]) << 64) // n_owners, bits)
    values, slot = np.unique(np.concatenate(keys), return_inverse=True)
    edges = np.append(0, np.cumsum(words + longer))
    place = np.concatenate([np.arange(words.sum()) + np.repeat(np.cumsum(longer) - longer, words), np.arange(longer.sum()) + np.repeat(np.cumsum(words), longer)])  # where each stands in its message
    counts = _read_numbers(group["counts"], group["n"].tolist())
    totals = np.bincount(slot, counts[place], len(values)).astype(np.int64)
    vocabulary = int(((values & WORD > 0) & (totals > 0)).sum())
    counts[place] = totals[slot]
    return pd.DataFrame({"batch": group["batch"], "owner": group["owner"], "n": group["n"], "totals": _numbers(counts, edges), "vocabulary": [vocabulary, *[0] * (len(group) - 1)]})


class Automaton:
    """The part of the backoff automaton that a batch reaches, in flat arrays.

    States and arcs are numbered by n-gram, those of length n from at[n] on; the root is
    the last state. arcs[d][i] is the arc that a state of depth d meets for the word at
    position i, -1 if it has none.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], slots: list[np.ndarray], total: int, vocabulary: int, strength: float):
        order = len(counts)
        at = np.append(0, np.cumsum([len(c) for c in counts]))
        self.root = root = int(at[-1])
        self.depth, self.fail_to, self.fail_weight = np.zeros(root + 1, np.int8), np.full(root + 1, root), np.zeros(root + 1)
        self.arc_weight, self.arc_to = np.zeros(root), np.full(root, root)
        self.arcs: list[np.ndarray] = []
        chance = np.zeros(0)
        for n in range(1, order + 1):
            count, slot, inside = counts[n - 1], slots[n - 1], grams.inside[n - 1]
            own = slice(int(at[n - 1]), int(at[n]))
            shorter, before = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
            if n == 1:
                chance = (count + 1) / (total + vocabulary + 1)
                found = slot
            else:
                ends = np.flatnonzero(inside)
                shorter[slot[ends]], before[slot[ends]] = slots[n - 2][ends], slots[n - 2][ends - 1]  # without the first word, and without the last
                chance = (count + strength * chance[shorter]) / (counts[n - 2][before] + strength)
                found = np.where(inside & (count[slot] > 0), slot, -1)
            self.arcs.append(np.where(found < 0, -1, found + at[n - 1]))
            self.arc_weight[own] = np.log10(chance)
            self.depth[own] = n
            self.fail_weight[own] = np.log10(strength / (count + strength))
            self.fail_to[own] = root if n == 1 else at[n - 2] + shorter
            # training has seen what the arc ends in, if it has seen the arc; the longest n-grams are no states
            self.arc_to[own] = np.where(count > 0, np.arange(own.start, own.stop) if n < order else at[n - 2] + shorter if n > 1 else root, root)

    def traverse(self, begin: int, end: int) -> float:
        """The log10 probability of the words from position begin + 1 to end - 1, begin being what stands before the text."""
        arcs = [memoryview(np.ascontiguousarray(x[begin:end])) for x in self.arcs]
        depth, fail_to, fail_weight, arc_weight, arc_to = (memoryview(x) for x in (self.depth, self.fail_to, self.fail_weight, self.arc_weight, self.arc_to))
        state = arc_to[arcs[0][0]]  # training with any document has seen what stands before one
        total = 0.0
        for i in range(1, end - begin):
            arc = arcs[depth[state]][i]
            while arc < 0:
                total += fail_weight[state]
                state = fail_to[state]
                arc = arcs[depth[state]][i]
            total += arc_weight[arc]
            state = arc_to[arc]
        return total


def _scores(frames, order: int, bits: int, strength: float, total: int, vocabulary: int, n_owners: int):
    for frame in frames:
        for row in frame.itertuples():
            grams = Grams(row, order, bits)
            distinct, slot = np.unique(grams.all_keys(), return_inverse=True)
            totals = np.zeros(len(distinct), np.int64)
            totals[_in_turn(_by_kind(distinct, n_owners)[1])] = _read_numbers([a["totals"] for a in row.answers], [a["n"] for a in row.answers])
            counts, slots = grams.by_length(slot, totals)
            automaton = Automaton(grams, counts, slots, total, vocabulary, strength)
            known = np.append(0, np.cumsum(counts[0][slots[0]] > 0))
            base = np.append(0, np.cumsum(np.log10((counts[0][slots[0]] + 1) / (total + vocabulary + 1))))
            starts, ends = grams.starts, grams.starts + grams.sizes
            nulls = np.frombuffer(row.nulls, np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(row.ids, "<i8"), mask=nulls), pa.array(~grams.train), pa.array(grams.sizes - 1), pa.array(known[ends] - known[starts + 1]),
                pa.array(base[ends] - base[starts + 1]), pa.array([automaton.traverse(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.float64()),
            ], names=["doc", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _score_rows(batches, *options):
    for batch in batches:
        yield from _scores([batch.to_pandas()], *options)


def score_documents(docs: DataFrame, train, order: int = 3, strength: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train: a boolean Column; the model learns from the rows where it is true (null is
    false). Tokens are the words and one end for each text; a null or blank text has
    the end only. score is the log10 probability of the tokens, base_score that of the
    unigram base. n_known counts tokens that training has seen, train_tokens is N.
    Rows that repeat count each; null ids stay null. With no training rows all counts
    are 0. An empty table gives an empty result. Other columns are ignored.

    Words are known by 62 bits of their hashes. Of longer n-grams, two in the corpus
    share a fingerprint with probability 2**-SLACK.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    words = size // 4 + 1  # more than there are, but for very short words
    bits = int(min(62, max(32, np.ceil(np.log2(words * order)) + SLACK)))
    n_owners = max(owners(spark), size // 6 * order // OWNER_NGRAMS + 1)
    batch_bytes = int(BATCH_BYTES * max(1.0, (size / SMALL) ** 0.5))
    home = written(rows.mapInArrow(lambda it: _batches(it, batch_bytes), HOME), "batches")
    sent = home.mapInPandas(lambda it: _messages(it, order, bits, n_owners), "batch long, owner int, n int, code binary, counts binary")
    answers = written(sent.groupBy("owner").applyInPandas(lambda g: _totals(g, bits, n_owners), "batch long, owner int, n int, totals binary, vocabulary long"), "totals")
    total = home.agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    vocabulary = answers.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0]
    packed = answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("owner", "n", "totals"))).alias("answers"))
    out = home.join(packed, "batch").mapInArrow(
        lambda it: _score_rows(it, order, bits, strength, total, vocabulary, n_owners),
        "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return out.select(F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
