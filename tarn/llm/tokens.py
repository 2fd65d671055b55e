"""Byte-level BPE ids of whole texts, through the tokenizers library.

The library splits a text into words before it merges bytes, and never merges
across words. Where a text's white space is single spaces and newlines between words,
a space belongs to the word after it and a newline is a word of its own. Such texts
are cut there, and between letters, digits and marks, as whole Arrow arrays; the library encodes each distinct word of a chunk
that is not remembered, and ids are gathered by word. Other texts, and those that hold
a special token's string, go to the library whole, as it is: special strings become
special ids.

What is remembered are flat arrays of words and ids, of a bounded number of words. Ids
never depend on it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarn.llm.common import kept

CHUNK = 4_000_000  # bytes of text encoded at a time; a longer text is a chunk of its own
_SPACE, _LINE, _OTHER = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[32], _CLASS[10] = _SPACE, _LINE
_CLASS[[9, 11, 12, 13, 28, 29, 30, 31]] = _OTHER
# lead byte of white space in UTF-8: its second bytes, or pairs of a second and its third bytes
_WIDE = {0xC2: {0x85: None, 0xA0: None}, 0xE1: {0x9A: (0x80,), 0xA0: (0x8E,)}, 0xE2: {0x80: (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), 0x81: (0x9F,)}, 0xE3: {0x80: (0x80,)}}

# ASCII letters, digits and marks
_SORT = np.zeros(256, np.uint8)
_SORT[33:127] = 3
_SORT[48:58] = 2
_SORT[[*range(65, 91), *range(97, 123)]] = 1
# a word of letters up to U+024F, in UTF-8
_LATIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+").fullmatch
# bytes of such words that byte-level models do not write as the character of that number: the n-th byte of all such is chr(256 + n)
_BYTES = [(chr(b), chr(256 + (b if b < 33 else b - 127 + 33 if b < 161 else 67))) for b in (32, *range(128, 161), 173)]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and the offsets of its values: views, no copies."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over raw; offsets has one more than it has values."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... sizes[i] of them, for all i in turn."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordCoder:
    """Texts to ids, by distinct words: each is coded once while it is remembered, and ids are gathered by word.

    A word is a space and what follows it, what follows a newline, or a newline. A
    subclass codes words and says which texts are odd: those where words are not coded
    apart, which it codes whole.
    """

    kinds = _CLASS
    most = 600_000  # words remembered by a task: about 30 MB

    def __init__(self, line: list[int]):
        self.line = line
        self.names = pa.array([b"\n"], pa.binary())
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.array([len(line)]), np.array(line, "<i8").astype("<u4")

    def odd(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def cuts(self, raw: np.ndarray) -> np.ndarray | None:
        """Where else words begin, from the second byte on."""
        return None

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        raise NotImplementedError

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in turn, and how many each has."""
        raise NotImplementedError

    def _codes(self, distinct: pa.Array) -> np.ndarray:
        """The place of each word in what is remembered, new ones learned; earlier ones are forgotten where it grows too large."""
        at = pc.index_in(distinct, value_set=self.names)
        new = pc.filter(distinct, pc.is_null(at))
        if len(new) + len(self.names) > self.most:
            held = np.unique(np.append(0, at.drop_null().to_numpy()))
            sizes = self.size[held]
            self.ids = self.ids[spread(self.first[held], sizes)]
            self.names, self.first, self.size = self.names.take(pa.array(held)), np.cumsum(sizes) - sizes, sizes
            at = pc.index_in(distinct, value_set=self.names)
        out = np.asarray(at.fill_null(-1)).astype(np.int64)
        if len(new):
            out[out < 0] = len(self.names) + np.arange(len(new))
            ids, sizes = self.learn(new)
            self.first = np.append(self.first, len(self.ids) + np.cumsum(sizes) - sizes)
            self.names, self.size, self.ids = pa.concat_arrays([self.names, new]), np.append(self.size, sizes), np.append(self.ids, ids)
        return out

    def _by_words(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of well-formed texts, and how many each has."""
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        begin = kind > 0
        begin[1:] |= kind[:-1] == _LINE
        more = self.cuts(raw)
        if more is not None:
            begin[1:] |= more
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(begin)
        coded = binary_array(raw, np.append(starts, len(raw))).dictionary_encode()
        word = self._codes(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.size[word]
        total = np.append(0, np.cumsum(sizes))
        return self.ids[spread(self.first[word], sizes)], np.diff(total[np.searchsorted(starts, offsets)])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn (unsigned 32-bit), and how many each text has. Text i is raw[offsets[i]:offsets[i + 1]]."""
        kind = self.kinds[raw]
        odd = self.odd(raw, kind, offsets)
        if not odd.any():
            return self._by_words(raw, kind, offsets)
        lengths, which = np.diff(offsets), np.flatnonzero(odd)
        good = np.repeat(~odd, lengths)
        even, counts = self._by_words(raw[good], kind[good], np.append(0, np.cumsum(lengths[~odd])))
        others = self.whole([raw[offsets[i] : offsets[i + 1]].tobytes() for i in which])
        sizes = np.zeros(len(lengths), np.int64)
        sizes[~odd], sizes[odd] = counts, [len(x) for x in others]
        out = np.empty(int(sizes.sum()), "<u4")
        inner = np.repeat(~odd, sizes)
        out[inner], out[~inner] = even, np.concatenate(others)
        return out, sizes


class Encoder(WordCoder):
    """The tokenizers library does the encoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.by_words = type(before).__name__ == "ByteLevel" and not before.add_prefix_space and self.tokenizer.normalizer is None and len(self.line) == 1
        self.split = self.by_words and before.use_regex
        model = self.tokenizer.model
        self.model = model if self.split and type(model).__name__ == "BPE" and not model.dropout else None

    def cuts(self, raw: np.ndarray) -> np.ndarray | None:
        """Between ASCII letters, digits and marks, where the library's own pattern always cuts; what follows an apostrophe may belong to it."""
        if not self.split:
            return None
        kind = _SORT[raw]
        return (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (raw[:-1] != 39)

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)]

    def odd(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are not words with single spaces and newlines between them, or hold a special token's string."""
        full = offsets[1:] > offsets[:-1]
        if not self.by_words:
            return full
        gap = kind > 0
        marked = kind == _OTHER
        marked[1:] |= gap[1:] & gap[:-1]
        marked[offsets[:-1][full]] |= gap[offsets[:-1][full]]
        marked[offsets[1:][full] - 1] |= gap[offsets[1:][full] - 1]
        high = np.flatnonzero(raw >= 0xC2)
        for lead, seconds in _WIDE.items():
            at = high[raw[high] == lead]
            two, three = raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
            for second, thirds in seconds.items():
                marked[at[(two == second) & (True if thirds is None else np.isin(three, thirds))]] = True
        text = raw.tobytes() if self.special else b""
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                marked[at] = True
                at = text.find(s, at + 1)
        return np.diff(np.append(0, np.cumsum(marked))[offsets]) > 0

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters go to the library's model at once, in its alphabet of bytes; of others many in one text."""
        names = words.to_pylist()
        plain = np.array([self.model is not None and _LATIN(w) is not None for w in names])
        if not plain.any():
            return self._learn_text(names)
        mapped = b"\n".join(w for w, p in zip(names, plain, strict=True) if p).decode("latin-1")
        for byte, letter in _BYTES:  # faster than translate(): most are not there
            mapped = mapped.replace(byte, letter)
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in mapped.split("\n")]
        others, counts = self._learn_text([w for w, p in zip(names, plain, strict=True) if not p])
        sizes = np.zeros(len(names), np.int64)
        sizes[plain], sizes[~plain] = [len(x) for x in found], counts
        out, inner = np.empty(int(sizes.sum()), "<u4"), np.repeat(plain, sizes)
        out[inner], out[~inner] = [i for x in found for i in x], others
        return out, sizes

    def _learn_text(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one text, a newline between two."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 200):
            found = np.array(self.tokenizer.encode_batch_fast([b"\n".join(words[i : i + 200]).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, "<u4")
            inner = found != self.line[0]
            flat.append(found[inner])
            sizes.append(np.diff(np.append(np.flatnonzero(~inner), len(found)), prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(sizes)


def encoder(path: str) -> Encoder:
    """A task's encoder; Python workers keep it until another operator's memory takes its place."""
    return kept(("encoder", path), lambda: Encoder(path))


def text_runs(texts: pa.Array, size: int = CHUNK):
    """(first, raw, offsets) for runs of the texts (without nulls) of about so many bytes; a longer text is a run of its own."""
    raw, offsets = flat_bytes(texts)
    first = 0
    while first < len(texts):
        last = min(len(texts), max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def encode_column(texts: pa.Array, path: str, end_id: int | None = None):
    """(first, ids, sizes) for each run of texts (a string array without nulls), in order: the ids of text first, first + 1, ...

    With end_id, each text has it after its own ids.
    """
    enc = encoder(path)
    for first, raw, offsets in text_runs(texts, CHUNK):
        ids, sizes = enc.encode(raw, offsets)
        if end_id is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
        yield first, ids, sizes


def encode_all(texts, path: str) -> list[bytes]:
    """The ids of each text (null: empty) as little-endian unsigned 32-bit bytes."""
    out: list[bytes] = []
    for _, ids, sizes in encode_column(pa.array([t or "" for t in texts], pa.string()), path):
        out += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out
