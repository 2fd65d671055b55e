"""Search for a set of queries at once: phrases, vectors, entities, expansion, fusion, evaluation.

A query set is a stated one and meets all rows. Texts are read once for a block of
BLOCK_PHRASES distinct phrases, which is more than five thousand queries ask for, or not at all where a
persistent index has their words (operators/textindex.py). Either way what is found is an
inverted file of phrases, and ranking is joins on it: a bound on the n-th best score tells
which phrases, and which of their postings, can still lead to a row among the n best.
Vectors are broadcast by the block and read where they lie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import words as W
from tarn.functions.text import cjk_trigrams, contains_cjk
from tarn.lineage import cut, few, kept, small_batches
from tarn.operators.retrieval import B, K1, RRF_K, boosted

BLOCK_QUERIES, BLOCK_PHRASES = 2048, 1 << 16  # taken at a time
BLOCK_TERMS = 1 << 18  # of a block of queries, some 15 MB in a task
OPENED = 1 << 17  # queries' looks at rows that are scored at a time
SCORED_ROWS, HELD_SCORES = 256, 1 << 19  # rows scored at a time against a block of queries (4 MB), and scores held before the best are taken
REMEMBERED = 1 << 19  # words of which a task knows what they hold, some 100 MB
IN_TURN = 6  # words that a phrase with white space is known by
_NEAR = np.uint64((1 << 20) - 1)
SLACK = 1e-6  # scores are rounded to 1e-9
MOST_TERMS, MOST_GRAMS = 12, 24


def query_phrases(text: Column, most_terms: int = MOST_TERMS) -> Column:
    """The phrases that a query asks for, any of which may be found: itself and its words, or its trigrams of ideographs.

    A query with * is its words, those with * as prefixes (in substring search the same).
    Phrases under three characters are in no trigram index and are left out.
    """
    norm = F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))
    terms = F.split(norm, " ")
    words = F.slice(F.regexp_extract_all(norm, F.lit("[\\p{L}\\p{N}_-]{2,}"), F.lit(0)), 1, most_terms)
    plain = F.concat(F.array(norm), words)
    starred = norm.contains("*") & F.forall(terms, lambda t: t.rlike("^[\\p{L}\\p{N}_-]+\\*?$"))
    wild = F.slice(F.transform(terms, lambda t: F.rtrim(t, F.lit("*"))), 1, most_terms)
    mixed = F.flatten(F.transform(terms, lambda t: F.when(contains_cjk(t), F.when(F.length(t) >= 3, cjk_trigrams(t)).otherwise(F.array().cast("array<string>"))).otherwise(F.filter(F.array(t), lambda x: x.rlike("^[\\p{L}\\p{N}_-]{2,}$")))))
    found = F.when(starred, wild).when(contains_cjk(norm), F.slice(F.array_distinct(mixed), 1, MOST_GRAMS)).otherwise(plain)
    return F.filter(F.array_distinct(found), lambda p: F.length(p) >= 3)


def _blocks(queries: DataFrame, columns: list[str], size: int) -> Iterator[list]:
    """The stated query set in blocks, on the driver."""
    block = []
    for row in queries.select(*columns).toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _bordered(phrase: str) -> bool:
    """Whether it may overlap with itself."""
    return any(phrase.endswith(phrase[:i]) for i in range(1, len(phrase)))


class Phrases:
    """An automaton of phrases, by place in their list."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.phrases, self.bordered, self.automaton = phrases, [_bordered(p) for p in phrases], ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            self.automaton.add_word(p, i)
        if phrases:
            self.automaton.make_automaton()

    def counts(self, low: str) -> tuple[list[int], list[int]]:
        """Which phrases a text holds, and how often each without overlaps."""
        tf = Counter(map(itemgetter(1), self.automaton.iter(low))) if self.phrases else {}
        return [*tf], [low.count(self.phrases[i]) if n > 1 and self.bordered[i] else n for i, n in tf.items()]


class _Sought:
    """Phrases to be found in many texts at once, by the words that lie between white space.

    A phrase without white space lies inside a word, so it is looked for in the distinct words
    only. Of another, what stands between its first and last white space are whole words of
    any text that holds it: up to IN_TURN of them are known by their hash (where there are none,
    its longest part is looked for inside words), and it is then counted in those texts.
    Words of a few thousand texts are told apart by 64 bits.
    """

    def __init__(self, phrases: list[str]):
        self.phrases, needles = phrases, {}
        keyed: list[list[tuple[list[str], int]]] = [[] for _ in range(IN_TURN)]
        plain, led = {}, {}  # by needle, the phrase that it is, and the phrases that it leads to
        for i, p in enumerate(phrases):
            parts = re.split("[\\t-\\r ]", p)
            if inner := [x for x in parts[1:-1] if x]:
                keyed[min(IN_TURN, len(inner)) - 1].append((inner[:IN_TURN], i))
            elif needle := max(parts, key=len):
                at = needles.setdefault(needle, len(needles))
                if len(parts) == 1:
                    plain[at] = i
                else:
                    led.setdefault(at, []).append(i)
        self.blank = [i for i, p in enumerate(phrases) if p and not p.strip("\t\n\x0b\f\r ")]  # these may be in any text
        self.needles = Phrases([*needles])
        self.bordered = np.array(self.needles.bordered, bool)
        self.plain = np.array([plain.get(i, -1) for i in range(len(needles))], np.int64)
        self.leads, self.led = np.array([i in led for i in range(len(needles))], bool), np.array([k for i in range(len(needles)) for k in led.get(i, [])], np.int64)
        self.led_at = np.append(0, np.cumsum([len(led.get(i, [])) for i in range(len(needles))])).astype(np.int64)
        self.places: dict[int, int] = {}  # of words that were met, what they hold
        self.heads, self.held = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.keys = []  # of one word, of two in turn and so on: hashes in order, the phrases, and which hashes may be among them
        for n, own in enumerate(keyed, 1):
            raw, offsets = W.flat(pa.array([w for words, _ in own for w in words], pa.string()))
            hashes = [*W.in_turn(W.hashes(raw, offsets[:-1], offsets[1:]), n)][-1][::n]
            order = np.argsort(hashes, kind="stable")
            near = np.zeros(1 << 20, bool)
            near[hashes & _NEAR] = True
            self.keys.append((hashes[order], np.array([i for _, i in own], np.int64)[order], near))

    def _inside(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which needles each of the distinct words holds, and how often, in one number (needle << 32 | times), word after word; and how many each holds."""
        lengths = ends - starts + 1  # with a space after each
        joined, after = np.full(int(lengths.sum()), 32, np.uint8), np.cumsum(lengths)
        letters = np.ones(len(joined), bool)
        letters[after - 1] = False
        joined[letters] = raw[(np.arange(len(joined)) + np.repeat(starts - (after - lengths), lengths))[letters]]
        characters, tokens, needles = np.cumsum((joined & 0xC0) != 0x80)[after - 1], joined.tobytes().decode(), self.needles.phrases
        met = np.fromiter(chain.from_iterable(self.needles.automaton.iter(tokens)), np.int64).reshape(-1, 2)
        pairs, times = np.unique((np.searchsorted(characters, met[:, 0], side="right") << 32) | met[:, 1], return_counts=True)
        token, needle = pairs >> 32, pairs & 0xFFFFFFFF
        for k in np.flatnonzero((times > 1) & self.bordered[needle]).tolist():  # without overlaps
            times[k] = tokens[characters[token[k] - 1] if token[k] else 0 : characters[token[k]]].count(needles[needle[k]])
        return (needle << 32) | times, np.bincount(token, minlength=len(starts))

    def _known(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each distinct word's place among those that are remembered."""
        if len(self.places) > REMEMBERED:
            self.places, self.heads, self.held = {}, np.zeros(1, np.int64), np.zeros(0, np.int64)
        places, known = self.places, hashes.tolist()
        new = np.array([i for i, h in enumerate(known) if h not in places], np.int64)
        if len(new):
            held, sizes = self._inside(raw, starts[new], ends[new])
            places.update(zip([known[i] for i in new.tolist()], range(len(places), len(places) + len(new)), strict=True))
            self.heads, self.held = np.append(self.heads, self.heads[-1] + np.cumsum(sizes)), np.append(self.held, held)
        return np.array([places[h] for h in known], np.int64)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, phrase, times of all that the texts (few thousands) hold, in the order of the texts."""
        raw, offsets = W.flat(texts)
        starts, ends = W.words(raw, offsets)
        hashes = W.hashes(raw, starts, ends)
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
        packed = np.zeros(0, np.int64)
        if len(hashes) and self.needles.phrases:
            code, own = pd.factorize(hashes)
            first = np.empty(len(own), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            word = self._known(raw, starts[first], ends[first], own)
            begins, sizes = self.heads[word], self.heads[word + 1] - self.heads[word]
            keys = np.sort(((text << 32) | code)[sizes[code] > 0])
            edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            often, keys = np.diff(np.append(edge, len(keys))), keys[edge]
            row, code = keys >> 32, keys & 0xFFFFFFFF
            sizes = sizes[code]
            k = np.arange(int(sizes.sum())) + np.repeat(begins[code] - (np.cumsum(sizes) - sizes), sizes)
            packed = self.held[k]
            again = np.repeat(often, sizes)
            more = np.flatnonzero(again > 1)
            packed[more] += (packed[more] & 0xFFFFFFFF) * (again[more] - 1)
            packed += np.repeat(row << 48, sizes)  # text, needle, times
            packed.sort()
        edge = np.flatnonzero(np.append(True, packed[1:] >> 32 != packed[:-1] >> 32)[: len(packed)])
        sums = np.add.reduceat(packed & 0xFFFFFFFF, edge) if len(edge) else edge
        row, needle = packed[edge] >> 48, packed[edge] >> 32 & 0xFFFF
        phrase = self.plain[needle]
        row_, phrase_, sums = row[phrase >= 0], phrase[phrase >= 0], sums[phrase >= 0]
        # phrases with white space are counted where they may be
        led = self.leads[needle]
        row, (at, k) = row[led], _spread(self.led_at[needle[led]], self.led_at[needle[led] + 1])
        phrase = self.led[k]
        likely = [row[at] * len(self.phrases) + phrase, *[np.arange(len(texts)) * len(self.phrases) + i for i in self.blank]]
        for n, ((known, led, near), met) in enumerate(zip(self.keys, W.in_turn(hashes, IN_TURN), strict=True), 1):
            if len(known) and len(met):
                place = np.flatnonzero(near[met & _NEAR] & (text[: len(met)] == text[n - 1 :]))
                a, b = np.searchsorted(known, met[place]), np.searchsorted(known, met[place], side="right")
                at, k = _spread(a, b)
                likely.append(text[place[at]] * len(self.phrases) + led[k])
        likely = np.unique(np.concatenate(likely))
        if len(likely):
            row, phrase = likely // len(self.phrases), likely % len(self.phrases)
            which, at = np.unique(row, return_inverse=True)
            low = texts.take(pa.array(which)).to_pylist()
            tf = np.array([low[j].count(self.phrases[i]) for j, i in zip(at.tolist(), phrase.tolist(), strict=True)], np.int64)
            row_, phrase_, sums = (np.append(x, y[tf > 0]) for x, y in ((row_, row), (phrase_, phrase), (sums, tf)))
            order = np.argsort(row_, kind="stable")
            row_, phrase_, sums = row_[order], phrase_[order], sums[order]
        return row_, phrase_, sums


def _spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all ranges, and which range each is of."""
    sizes = ends - begins
    at = np.repeat(np.arange(len(sizes)), sizes)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)


def _occurrences(batches, names: list[int], phrases: list[str]):
    own, at = _Sought(phrases), np.array(names, np.int64)
    for batch in (x.slice(k, 1024) for x in batches for k in range(0, len(x), 1024)):
        texts = batch.column("low")
        row, phrase, times = own.counts(texts)
        held, sizes = np.unique(row, return_counts=True)
        lengths = np.maximum(1, pc.utf8_length(texts).to_numpy().astype(np.int64)[held] - 2)
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(at[phrase]), pa.array(times.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(held)), pa.array(lengths), *lists], names=["id", "dl", "at", "tf"])


def occurrences(docs: DataFrame, names: list[int], phrases: list[str], id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, dl (trigrams of the text), at and tf (the names of the lower-case phrases, and how often) of the texts that hold any, in one pass."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("low"))
    return rows.mapInArrow(lambda it: _occurrences(it, names, phrases), "id long, dl long, at array<long>, tf array<int>")


def phrase_hits(docs: DataFrame, phrases: list[str], id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, phrase, tf, dl for each lower-case phrase that a text holds."""
    rows = occurrences(docs, [*range(len(phrases))], phrases, id_col, text_col).select("id", "dl", F.explode(F.arrays_zip("at", "tf")).alias("x"))
    named = docs.sparkSession.createDataFrame([*enumerate(phrases)], "at long, phrase string")
    return rows.select("id", "dl", "x.at", "x.tf").join(F.broadcast(named), "at").select("id", "phrase", "tf", "dl")


def asked_phrases(queries: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """query_id, at, phrase of queries (query_id, query): what each asks for; at is the phrase's 64-bit hash."""
    asked = queries.select("query_id", F.explode(query_phrases(F.col("query"), most_terms)).alias("phrase"))
    return cut(asked.select("query_id", F.xxhash64("phrase").alias("at"), "phrase"))


def scanned(docs: DataFrame, phrases: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, dl, at, tf of all distinct phrases (at, phrase), a row for each id: texts are read once for a block of BLOCK_PHRASES."""
    out, blocks = None, 0
    for block in _blocks(phrases.select("at", "phrase").distinct(), ["at", "phrase"], BLOCK_PHRASES):
        found = occurrences(docs, [r["at"] for r in block], [r["phrase"] for r in block], id_col, text_col)
        out, blocks = found if out is None else out.unionByName(found), blocks + 1
    if out is None:
        return docs.sparkSession.createDataFrame([], "id long, dl long, at array<long>, tf array<int>")
    if blocks == 1:
        return out
    return out.groupBy("id").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("at", "tf")).alias("x")).select("id", "dl", F.flatten("x.at").alias("at"), F.flatten("x.tf").alias("tf"))  # an entry for each block


class _Terms:
    """What a block of queries asks for: its terms, and those of them that bring rows in."""

    def __init__(self, rows: list, avgdl: float):
        self.avgdl = avgdl
        self.queries, query = np.unique(np.array([r["query_id"] for r in rows], np.int64), return_inverse=True)
        at, self.idf = np.array([r["at"] for r in rows], np.int64), np.array([r["idf"] for r in rows], float)
        self.phrases, phrase = np.unique(at, return_inverse=True)
        opens = np.array([r["opens"] for r in rows], bool)
        order = np.flatnonzero(~opens)
        order = order[np.argsort(query[order], kind="stable")]
        self.begins, self.phrase, self.weight = np.searchsorted(query[order], np.arange(len(self.queries) + 1)), phrase[order], self.idf[order]  # of terms that bring no rows in
        self.rest = np.bincount(query[order], np.array([r["most"] for r in rows], float)[order], len(self.queries))  # the most that these give a query's row
        least, share = np.array([r["least"] for r in rows], float), np.array([r["share"] for r in rows], float)
        opens = np.flatnonzero(opens)
        opens = opens[np.argsort(phrase[opens], kind="stable")]
        self.heads = np.searchsorted(phrase[opens], np.arange(len(self.phrases) + 1))
        self.to, self.to_idf, self.least, self.share = query[opens], self.idf[opens], least[opens], share[opens]
        self.floor = np.full(len(self.queries), -np.inf)
        np.maximum.at(self.floor, query, np.array([r["floor"] for r in rows], float))
        self.until = np.zeros(len(self.queries), np.int64)
        self.until[query] = np.array([r["until"] for r in rows], np.int64)

    def places(self, at: np.ndarray) -> np.ndarray:
        """Of each hit, its phrase's place; -1 if no query asks for it."""
        if not len(self.phrases):
            return np.full(len(at), -1)
        place = np.minimum(np.searchsorted(self.phrases, at), len(self.phrases) - 1)
        return np.where(self.phrases[place] == at, place, -1)

    def opened(self, place: np.ndarray) -> np.ndarray:
        """How many queries each hit brings its row in for."""
        return np.where(place >= 0, self.heads[place + 1] - self.heads[place], 0)

    def scores(self, ids: np.ndarray, dl: np.ndarray, doc: np.ndarray, place: np.ndarray, tf: np.ndarray, stamp: np.ndarray):
        """query_id, id and score of the rows that open terms bring in, whose stamps are below their query's, and that reach its floor. doc: places in ids, ascending; place: of places()."""
        known = place >= 0
        doc, place, tf = doc[known], place[known], tf[known].astype(float)
        unit = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / self.avgdl))
        times = self.heads[place + 1] - self.heads[place]
        row = np.repeat(np.arange(len(place)), times)
        term = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + self.heads[place[row]]
        part = self.to_idf[term] * unit[row]
        within = (part >= self.least[term]) & ((ids[doc[row]] * 0x9E3779B1 & 0xFFFFFFFF) < self.share[term] * 4294967296.0)
        pairs, pair = np.unique(doc[row] * len(self.queries) + self.to[term], return_inverse=True)
        score, met = np.bincount(pair, part, len(pairs)).astype(float), np.bincount(pair[within], minlength=len(pairs)) > 0
        d, q = pairs // max(len(self.queries), 1), pairs % max(len(self.queries), 1)
        # what open terms give a row is known; few can still reach the floor by the others
        able = np.flatnonzero(met & (stamp[d] < self.until[q]) & (score + self.rest[q] >= self.floor[q]))
        d, q, score = d[able], q[able], score[able]
        # each pair's query's other terms, looked up among the row's phrases
        keys = doc * len(self.phrases) + place
        order = np.argsort(keys)
        keys, unit = keys[order], unit[order]
        sizes = self.begins[q + 1] - self.begins[q]
        pair = np.repeat(np.arange(len(able)), sizes)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.begins[q[pair]]
        wanted = d[pair] * len(self.phrases) + self.phrase[k]
        found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        part = np.where(keys[found] == wanted, self.weight[k] * unit[found], 0.0) if len(keys) else np.zeros(0)
        score = np.round(score + np.bincount(pair, part, len(able)), 9)  # equal texts have equal scores, in whatever order they were added up
        kept = (score > 0) & (score >= self.floor[q])
        return self.queries[q[kept]], ids[d[kept]], score[kept]


def _scored(batches, terms: _Terms):
    for batch in batches:
        for k in range(0, len(batch), 1024):
            own = batch.slice(k, 1024)
            at, tf = own.column("at"), own.column("tf")
            offsets = at.offsets.to_numpy().astype(np.int64) - at.offsets[0].as_py()
            place, tf, ids, dl = terms.places(at.flatten().to_numpy()), tf.flatten().to_numpy(), own.column("id").to_numpy(), own.column("dl").to_numpy()
            stamp = own.column("stamp").to_numpy()
            # a row that many queries look at counts for each of them: rows are taken by what they open
            opened = np.append(0, np.cumsum(terms.opened(place)))[offsets]
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(opened, opened[first] + OPENED, side="right")) - 1)
                span = slice(offsets[first], offsets[last])
                sizes = np.diff(offsets[first : last + 1])
                found = terms.scores(ids[first:last], dl[first:last], np.repeat(np.arange(len(sizes)), sizes), place[span], tf[span], stamp[first:last])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "id", "score"])
                first = last


def ranked(hits: DataFrame, asked: DataFrame, rows: int, avgdl: float, n: int | None = None, limits: DataFrame | None = None) -> DataFrame:
    """query_id, id, score by BM25. hits: id, dl, at, tf (arrays), a row for each id; asked: query_id, at; rows, avgdl: of all texts.

    With n, the n best of each query are among the rows, and most others are left out. The
    rows that a query's rarest phrases find (of a common one, a share) give a bound that
    its n best reach.
    Phrases in order of the most that they give anywhere: a row whose first phrase gives
    less than the bound, less the most that all later ones give, is out of reach. So the
    common phrases of a query seldom bring rows in; they only add to the scores of rows
    that others found. Rows are scored where their hits lie, and those below the bound
    never leave the task.

    With limits (query_id, until, share, n; until and n may not be null), hits have a stamp
    (long), and a query takes only rows whose stamps are below its until, which about so large
    a share of rows are; the n best are then of each query's own number.
    """
    spark = hits.sparkSession
    hits = kept(hits if limits is not None else hits.withColumn("stamp", F.lit(0).cast("long")), "hits")  # read for frequencies, bounds and scores
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    postings = hits.select("dl", F.explode(F.arrays_zip("at", "tf")).alias("x")).select("x.at", "dl", "x.tf").select("at", norm.alias("unit"))
    idf = F.greatest(F.lit(1e-6), F.log(F.greatest((F.lit(rows) - F.col("df") + 0.5) / (F.col("df") + 0.5), F.lit(1e-300))))
    stats = postings.groupBy("at").agg(F.count("*").alias("df"), F.max("unit").alias("top")).select("at", "df", idf.alias("idf"), (idf * F.col("top")).alias("most"))
    by_most, rarest = Window.partitionBy("query_id").orderBy(F.desc("most"), "at"), Window.partitionBy("query_id").orderBy("df", "at")
    later = F.coalesce(F.sum("most").over(by_most.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    terms = kept(asked.join(stats, "at").select("query_id", "at", "df", "idf", "most", later.alias("later"), before.alias("before")), "terms")  # some MOST_TERMS + 1 a query
    limits = None if limits is None else kept(limits.select("query_id", "until", F.col("share").alias("part"), "n"), "limits")
    terms = terms.withColumns({"until": F.lit(1).cast("long"), "part": F.lit(1.0), "n": F.lit(n)}) if limits is None else terms.join(limits, "query_id")
    blocks = terms.count() // BLOCK_TERMS + 1

    def scores(own: DataFrame) -> DataFrame:
        """own: query_id, at, idf, and for each term whether it opens, the least that it must give, the share of ids that it is asked of, and its query's floor."""
        out = None
        for k in range(blocks):
            block = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).select("query_id", "at", "idf", "most", "opens", "least", "share", "floor", "until").collect()
            if block:
                held = spark.sparkContext.broadcast(_Terms(block, avgdl))
                found = hits.mapInArrow(lambda it, held=held: _scored(it, held.value), "query_id long, id long, score double")
                out = found if out is None else out.unionByName(found)
        return out if out is not None else spark.createDataFrame([], "query_id long, id long, score double")

    always = {"least": F.lit(float("-inf")), "floor": F.lit(float("-inf"))}
    if n is None and limits is None:
        return scores(terms.withColumns({"opens": F.lit(True), "share": F.lit(1.0), **always}))
    asked_of = F.col("n") / F.greatest("part", F.lit(1e-6))  # so many rows have n that a query may take
    seeds = scores(terms.withColumns({"opens": F.col("before") < 4 * asked_of, "share": F.least(F.lit(1.0), 50 * asked_of / F.col("df")), **always}))
    seeds = seeds.withColumn("n", F.lit(n)) if limits is None else seeds.join(limits.select("query_id", "n"), "query_id")
    best = seeds.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= F.col("n"))
    bound = kept(best.groupBy("query_id").agg(F.when(F.max("r") == F.max("n"), F.min("score") - SLACK).alias("floor")), "bounds")
    floor = F.coalesce("floor", F.lit(float("-inf")))
    least = floor - F.col("later")
    return scores(terms.join(bound, "query_id", "left").withColumns({"opens": F.col("most") >= least, "least": least, "share": F.lit(1.0), "floor": floor}))


def bm25_search(docs: DataFrame, queries: DataFrame, n: int | None = None, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """query_id, id, score: each query's rows by BM25 over its phrases. queries: query_id, query.

    Rare phrases weigh more, down to a floor for those in half of all rows. With n, the n
    best of each query are among the rows, and most others are left out.
    """
    texts = docs.where(F.col(text_col).isNotNull())
    totals = texts.agg(F.count("*").alias("n"), F.avg(F.greatest(F.lit(1), F.length(text_col) - 2)).alias("avgdl")).first()
    asked = asked_phrases(queries)
    return ranked(scanned(docs, asked, id_col, text_col), asked.select("query_id", "at"), totals["n"], totals["avgdl"] or 1.0, n)


def _nearest(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query; ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], score[place < k]


def _best(batches, ids: np.ndarray, targets: np.ndarray, k: int):
    """The k best rows of the task for each query. Rows are scored a few at a time; what reaches a query's k-th best so far is held."""
    least = np.full(len(ids), -np.inf)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    more, n = [], 0

    def settled():
        found = _nearest(*(np.concatenate(x) for x in zip(held, *more, strict=True)), k)
        full = np.flatnonzero(np.bincount(found[0], minlength=len(ids)) == k)
        least[full] = found[2][np.searchsorted(found[0], full, side="right") - 1]
        return found

    for batch in batches:
        for at in range(0, len(batch), SCORED_ROWS):
            part = batch.slice(at, SCORED_ROWS)
            own = part.column("id").to_numpy()
            rows = part.column("vec").flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
            lengths = np.sqrt(np.einsum("nd,nd->n", rows, rows))
            score = np.round((rows @ targets.T) / np.where(lengths > 0, lengths, np.inf)[:, None], 12)  # equal vectors tie, however products are grouped
            row, query = np.nonzero(score >= least)
            more.append((query, own[row], score[row, query]))
            n += len(row)
            if n > HELD_SCORES:
                held, more, n = settled(), [], 0
    query, own, score = settled() if more else held
    yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(own), pa.array(score)], names=["query_id", "id", "score"])


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, score: each query's k or more nearest rows by cosine, found by a full scan. queries: query_id, vec.

    Zero vectors score zero; null vectors and those of another length take no part.
    """
    spark, out = vectors.sparkSession, None
    small_batches(spark)
    asked = queries.where(F.col("vec").isNotNull()).select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    for block in _blocks(asked, ["query_id", "vec"], BLOCK_QUERIES):
        for dim in sorted({len(r["vec"]) for r in block}):
            own = [r for r in block if len(r["vec"]) == dim]
            ids, targets = np.array([r["query_id"] for r in own], np.int64), np.array([r["vec"] for r in own], np.float64)
            lengths = np.sqrt(np.einsum("nd,nd->n", targets, targets))
            targets = targets / np.where(lengths > 0, lengths, np.inf)[:, None]
            rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim) & F.forall(vec_col, lambda x: x.isNotNull())).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            found = rows.mapInArrow(lambda it, ids=ids, targets=targets: _best(it, ids, targets, k), "query_id long, id long, score double")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, score double")


def top_per_query(scored: DataFrame, n: int, rank: str) -> DataFrame:
    """query_id, id, rank of each query's n best; ties to the smaller id."""
    along = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn(rank, F.row_number().over(along)).where(F.col(rank) <= n).select("query_id", "id", rank)


def entity_routed(names: DataFrame, links: DataFrame, entities: DataFrame, aliases: DataFrame, memories: DataFrame, n: int) -> DataFrame:
    """query_id, id, entity_rank: rows that hold an entity which the query names, by itself or an alias.

    names: query_id, place, name (the first six count). A name's newest n rows come before
    the next name's; a row has its first place only.
    """
    known = entities.select(F.col("id").alias("entity_id"), "name").unionByName(aliases.select("entity_id", F.col("alias").alias("name"))).distinct()
    found = names.where("place < 6").join(known, "name").select("query_id", "place", "entity_id")
    # a hot entity's rows are ranked once, and only its newest n meet the queries
    dated = links.select("entity_id", F.col("memory_id").alias("id")).distinct().join(memories.select("id", "updated"), "id")
    ranked_rows = dated.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("updated"), "id"))).where(F.col("r") <= n).drop("r")
    met = found.join(ranked_rows, "entity_id").groupBy("query_id", "place", "id").agg(F.first("updated").alias("updated"))
    newest = met.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.desc("updated"), "id"))).where(F.col("r") <= n)
    first = newest.groupBy("query_id", "id").agg(F.min(F.struct("place", "r")).alias("at"))
    return first.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")).alias("entity_rank"))


def expanded(found: DataFrame, links: DataFrame, relations: DataFrame, allowed: DataFrame, fewest: int = 3, most: int = 20, rounds: int = 3) -> DataFrame:
    """query_id, id, hop_rank: for queries with fewer results than fewest, what their results' entities and those related to them lead to.

    allowed: id, updated of the rows that may be added. A round adds the newest; rounds go
    on while a query is still short of results. found: query_id, id. links and relations may
    repeat rows.
    """
    both = relations.select("source_id", "target_id").unionByName(relations.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    dated = links.select("entity_id", F.col("memory_id").alias("id")).join(allowed.select("id", "updated"), "id")
    have, out = kept(found.select("query_id", "id").distinct(), "have"), None
    along = Window.partitionBy("query_id").orderBy(F.desc("updated"), "id")
    for last in range(rounds - 1, -1, -1):
        sparse = have.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") < fewest).select("query_id")
        own = kept(have.join(sparse, "query_id"), "sparse").withColumnRenamed("id", "memory_id")
        seeds = kept(links.join(few(own), "memory_id").select("query_id", "entity_id").distinct(), "seeds")
        led = both.join(few(seeds.withColumnRenamed("entity_id", "source_id")), "source_id").select("query_id", F.col("target_id").alias("entity_id"))
        near = seeds.unionByName(led).distinct()
        # a short query has fewer results than fewest, so its newest rows are among so many; ranks that equal rows share are cut before they are dealt out
        newest = near.join(dated, "entity_id").select("query_id", "id", "updated").withColumn("r", F.dense_rank().over(along)).where(F.col("r") < most + fewest)
        met = newest.select("query_id", "id", "updated").distinct().join(have, ["query_id", "id"], "left_anti")
        new = met.withColumn("hop_rank", F.row_number().over(along)).where(F.col("hop_rank") <= most).select("query_id", "id", "hop_rank")
        new = kept(new, "new") if last else new
        out = new if out is None else out.unionByName(new)
        have = have.unionByName(new.select("query_id", "id"))
    return out


def fused(full_text: DataFrame, by_vector: DataFrame, by_entity: DataFrame, by_hops: DataFrame | None = None) -> DataFrame:
    """query_id, id, ft_rank, sem_rank, rrf: reciprocal rank fusion.

    A row that only an entity found takes its place there as its vector rank; one that
    only the expansion found ranks from 100 on.
    """
    joined = full_text.join(by_vector, ["query_id", "id"], "full_outer").join(by_entity, ["query_id", "id"], "full_outer")
    only = F.when(F.col("ft_rank").isNull() & F.col("sem_rank").isNull(), F.col("entity_rank"))
    rows = joined.select("query_id", "id", "ft_rank", F.coalesce("sem_rank", only).alias("sem_rank"))
    if by_hops is not None:
        more = by_hops.select("query_id", "id", F.lit(None).cast("int").alias("ft_rank"), (F.col("hop_rank") + 99).alias("sem_rank"))
        rows = rows.unionByName(more)
    part = lambda c: F.coalesce(0.5 / (RRF_K + F.col(c)), F.lit(0.0))
    return rows.withColumn("rrf", part("ft_rank") + part("sem_rank"))


def explained(found: DataFrame, memories: DataFrame, n: int) -> DataFrame:
    """Each query's n best with the parts of their scores. memories: id, hit_count, confidence, layer."""
    own = found.join(memories.select("id", "hit_count", "confidence", "layer"), "id")
    durable = F.col("layer").isin("long", "entity")
    score = boosted(F.col("rrf"), F.col("hit_count"), F.col("confidence"), durable)
    part = lambda c: F.round(F.coalesce(0.5 / (RRF_K + F.col(c)), F.lit(0.0)), 8)
    rows = own.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)
    return rows.select(
        "query_id", "rank", "id", "ft_rank", "sem_rank", part("ft_rank").alias("ft_part"), part("sem_rank").alias("sem_part"),
        F.round(F.least(F.lit(0.006), F.log1p("hit_count") * 0.0015), 8).alias("hit_boost"), F.round(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * 0.003, 8).alias("confidence_boost"),
        F.when(durable, 0.002).otherwise(0.0).alias("layer_boost"), F.round(F.col("score"), 8).alias("score"),
    )


def recall_and_mrr(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """queries, recall at each k and mean reciprocal rank. ranked: query_id, id, rank; gold: query_id, id."""
    asked = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = gold.join(ranked, ["query_id", "id"], "left").groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in ks], F.min("rank").alias("first"))
    rows = asked.join(hits, "query_id")
    return rows.agg(
        F.count("*").alias("queries"), *[F.round(F.avg(F.col(f"hit_{k}") / F.col("n_gold")), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


def reinforced(logged: DataFrame, edges: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """source, target, strength after co-hits: pairs among each search's first hits, in rank order.

    The third time together makes an edge of 0.2; each later time, and each time of a known
    edge, adds 0.05, up to 1. logged: query_id, rank, id; edges: source, target, strength.
    """
    first = logged.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("hits"))
    # at most top hits a search, so at most top * (top - 1) / 2 pairs
    pairs = first.select(F.explode(F.flatten(F.transform("hits", lambda x, i: F.transform(F.slice("hits", i + 2, top), lambda y: F.struct(x["id"].alias("source"), y["id"].alias("target")))))).alias("p"))
    counted = pairs.groupBy("p.source", "p.target").agg(F.count("*").alias("times"))
    joined = counted.join(edges, ["source", "target"], "full_outer")
    times = F.coalesce("times", F.lit(0))
    grown = F.when(F.col("strength").isNotNull(), F.least(F.lit(1.0), F.col("strength") + 0.05 * times)).when(times >= least, F.least(F.lit(1.0), 0.2 + 0.05 * (times - least)))
    return joined.select("source", "target", F.round(grown, 6).alias("strength")).where("strength IS NOT NULL")


def with_hits(memories: DataFrame, logged: DataFrame, at: Column) -> DataFrame:
    """memories after hits were recorded: hit_count, last_hit_at, and decay_factor raised by a fifth a hit, up to 1."""
    hits = logged.groupBy("id").agg(F.count("*").alias("new_hits"))
    own = [c for c in memories.columns if c not in ("hit_count", "last_hit_at", "decay_factor")]
    new = F.coalesce("new_hits", F.lit(0))
    return memories.join(hits, "id", "left").select(
        *own, (F.col("hit_count") + new).alias("hit_count"), F.when(new > 0, at).otherwise(F.col("last_hit_at")).alias("last_hit_at"), F.least(F.lit(1.0), F.col("decay_factor") * F.pow(F.lit(1.2), new)).alias("decay_factor")
    )
