"""A piece vocabulary as a path problem, and its transfer matrices.

A segmentation of a text into pieces is the model's own exactly when each piece is what
the model makes of its own string, and each two neighbours are what the model makes of
theirs. Paths through the text carry the piece they came by; their weight is the sum of
their pieces' scores, and -inf where two neighbours don't fit, so the model's own
segmentation is the best path in the (max, +) semiring, and the only one above -inf.

Two pieces fit if no merge across their border would have come before those that made
them: their merges are undone one by one, the latest first.

A cut in a text is crossed by one piece. The pieces that may cross it are the boundary
states; a chunk's transfer matrix holds, for each state at its start and each at its
end, the best path's weight. Matrices combine associatively, and once the states at all
cuts are known, each chunk finds its own pieces.

Spaces in a row tie in score. The model joins them last, so paths are sought with one
space for each run, and what the run's other spaces make is put in afterwards.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece

from tarn.llm.common import kept
from tarn.llm.tokens import WordCoder, flat_bytes, spread

SPACE = "▁"
RUN = re.compile(SPACE + "{2,}")
NONE = float("-inf")
UNKNOWN = -1e6  # the score of a character that is no piece
MEMORY = 1 << 19  # places of the table in which a task remembers which pieces fit: under 5 MB; half of them are used at most
LONGEST_WORD = 48  # characters; longer words are segmented one by one
_KINDS = np.zeros(256, np.uint8)
_KINDS[32], _KINDS[10] = 1, 2


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(self.names))]
        self.ids = {p: i for i, p in enumerate(self.names) if not self.special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.whole_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)  # no piece goes on after a word's end
        self.prefixes = {p[:i] for p in self.ids for i in range(1, len(p))}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the model makes of a short string: the best-scored neighbours join first, the leftmost of equals."""
        return self._merging(text)[0]

    def _merging(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Its pieces, and the two that joined last."""
        parts, latest = list(text), None
        while len(parts) > 1:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            latest = (parts[at], parts[at + 1])
            parts[at : at + 2] = ["".join(latest)]
        return parts, latest

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that it was made of; itself twice if it is one character; None if the model never makes it."""
        found = self.halves.get(piece, 0)
        if found == 0:
            parts, latest = self._merging(piece)
            found = self.halves[piece] = None if len(parts) > 1 else latest or (piece, piece)
        return found

    def fit(self, one: str, two: str) -> bool:
        """Whether two pieces may stand side by side; one is empty at a text's start."""
        found = self.fits.get((one, two))
        if found is None:
            if len(self.fits) >= 50_000:
                self.fits.clear()
            found = self.fits[(one, two)] = self._compatible(one, two)
        return found

    def _compatible(self, one: str, two: str) -> bool:
        halves, score = self._halves, self.score.get
        if halves(two) is None or (one and halves(one) is None):
            return False
        if not one:
            return True
        worst, tie = NONE, True  # merges across the border that are better than this came first; of equals, the left one does
        while True:
            across = score(one + two)
            if across is not None and (across > worst or (across == worst and not tie)):
                return False
            # undo the later of the two merges; one character is there from the start
            a, b = (score(one) if len(one) > 1 else None), (score(two) if len(two) > 1 else None)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a < b):
                worst, tie, one = a, True, halves(one)[1]
            else:
                worst, tie, two = b, False, halves(two)[0]

    def forward(self, text: str, start: int, came_by: str, end: int) -> tuple[list[str | None], list[float]]:
        """By position: the last piece of the best path from start, and the path's weight.

        The path came to start by a piece that is known. Positions run to end. As only
        one piece fits after each prefix, a position holds one piece.
        """
        last: list[str | None] = [None] * (end + 1)
        weight = [NONE] * (end + 1)
        last[start], weight[start] = came_by, 0.0
        score, prefixes, fit = self.score, self.prefixes, self.fit
        for q in range(start, end):
            before = last[q]
            if before is None:
                continue
            for p in range(q + 1, end + 1):
                piece = text[q:p]
                if last[p] is None and (piece in score or p == q + 1) and fit(before, piece):
                    last[p], weight[p] = piece, weight[q] + score.get(piece, UNKNOWN)
                if piece not in prefixes:
                    break
        return last, weight

    def path(self, last: list[str | None], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(out[-1])
        return out[::-1]

    def numbers(self, parts: list[str]) -> list[int]:
        """Ids of pieces; a character that is no piece becomes its bytes, or the unknown id where there are none."""
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def collapsed(self, marked: str) -> tuple[str, dict[int, int]]:
        """The text with one space for each run of them, and the runs: by their place in it, how many spaces."""
        runs, out, at, gone = {}, [], 0, 0
        for run in RUN.finditer(marked) if self.whole_words else ():
            out.append(marked[at : run.start() + 1])
            runs[run.start() - gone] = run.end() - run.start()
            gone += run.end() - run.start() - 1
            at = run.end()
        return "".join([*out, marked[at:]]), runs

    def expanded(self, parts: list[str], runs: dict[int, int], at: int) -> list[str]:
        """Pieces of a collapsed text from place at on, with those of the runs' other spaces."""
        if not runs:
            return parts
        out: list[str] = []
        for p in parts:
            n = runs.get(at, 0)
            if n and p == SPACE:  # no letter took the run's last space
                out += self.merged_long(SPACE * n)
            else:
                out += [*self.merged_long(SPACE * (n - 1)), p] if n else [p]
            at += len(p)
        return out

    def segment(self, marked: str) -> list[str]:
        """A whole string's pieces, by one chunk."""
        text, runs = self.collapsed(marked)
        last, _ = self.forward(text, 0, "", len(text))
        return self.expanded(self.path(last, 0, len(text)), runs, 0) if last[-1] is not None else self.merged_long(marked)

    def merged_long(self, text: str) -> list[str]:
        """merged() with a heap: for long strings."""
        import heapq

        n = len(text)
        part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i):
            j = after[i]
            if j < n and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b or not a:
                continue
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The pieces (start, end) that may cover the character before the cut."""
        return [(a, b) for a in range(max(0, cut - self.longest), cut) for b in range(cut, min(len(text), a + self.longest) + 1) if b == a + 1 or text[a:b] in self.ids]

    def transfer(self, text: str, starts: list[tuple[int, int]] | None, cut: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The chunk's matrix: from the pieces that may cross its start (None: the text's start) to those that may cross its end."""
        ends = self.states(text, cut) if cut < len(text) else [(len(text), len(text))]
        out = np.full((1 if starts is None else len(starts), len(ends)), NONE)
        for i, (a, b) in enumerate(starts or [(0, 0)]):
            last, weight = self.forward(text, b, text[a:b], max(max(e for _, e in ends), b))
            for j, (s, e) in enumerate(ends):
                if (s, e) == (a, b) or s == e == b:
                    out[i, j] = 0.0  # one piece crosses the whole chunk, or all that is left of the text
                elif e > b and last[e] is not None and (s == e or len(last[e]) == e - s):
                    out[i, j] = weight[e]
        return out, ends


def combined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (one[:, :, None] + two[None, :, :]).max(axis=1) if one.size and two.size else np.full((len(one), two.shape[1]), NONE)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairing neighbours."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = [combined(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
    done = scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(done[i // 2] if i % 2 else combined(done[i // 2 - 1], matrices[i]))
    return out


class PieceCoder(WordCoder):
    """Texts to ids by the best path of each distinct word, for many words at once.

    Words are cut where no piece goes on: before a space, and around a newline that is
    no piece. Each position of all words is taken in one step: a trie finds the pieces
    that begin there, and the piece that the path came by says which of them fit.
    """

    kinds = _KINDS
    most = 400_000

    def __init__(self, path: str):
        self.pieces = own = Pieces(path)
        super().__init__(own.numbers(["\n"]))
        self.by_words = own.whole_words and not any("\n" in p for p in own.ids)
        letters = sorted({c for p in own.ids for c in p})
        self.letters = np.array([ord(c) for c in letters])
        number, self.n_letters = {c: i for i, c in enumerate(letters)}, len(letters) + 1  # one more for all other characters
        steps: dict[int, int] = {}
        ends = [-1]
        for p, i in own.ids.items():
            node = 0
            for c in p:
                key = node * self.n_letters + number[c]
                node = steps.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        order = np.argsort(keys := np.fromiter(steps.keys(), np.int64, len(steps)))
        self.steps, self.step_to, self.ends = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order], np.array(ends)
        self.other, self.start = len(own.names), len(own.names) + 1  # a character that is no piece, and what stands before a word
        self.strings = [*own.names, "\U0010fffd", ""]
        self.pairs, self.fitting, self.n_pairs = np.zeros(MEMORY, np.int64), np.zeros(MEMORY, bool), 0  # by hash, with open addresses

    def odd(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with spaces in a row, or with the character that stands for a space."""
        if not self.by_words:
            return offsets[1:] > offsets[:-1]
        marked = np.zeros(len(raw), bool)
        marked[1:] = (kind[1:] == 1) & (kind[:-1] == 1)
        three = SPACE.encode()
        at = np.flatnonzero(raw[:-2] == three[0]) if len(raw) > 2 else np.zeros(0, np.int64)
        marked[at[(raw[at + 1] == three[1]) & (raw[at + 2] == three[2])]] = True
        return np.diff(np.append(0, np.cumsum(marked))[offsets]) > 0

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        own = self.pieces
        return [np.array(own.numbers(own.segment(t.decode("utf-8", "surrogatepass").replace(" ", SPACE))), "<u4") for t in texts]

    def encode_texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts as they are: the model puts a space before each that is not empty."""
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        return self.encode(np.insert(raw, full, 32), offsets + np.append(0, np.cumsum(offsets[1:] > offsets[:-1])))

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = flat_bytes(words)
        lengths = np.diff(np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets])
        sizes = np.zeros(len(words), np.int64)
        apart: dict[int, np.ndarray] = {}
        flat, places = [], []
        order = np.argsort(lengths, kind="stable")  # words of like lengths go together
        for i in range(0, len(order), 8192):
            own = order[i : i + 8192]
            short = own[lengths[own] <= LONGEST_WORD]
            odd = np.zeros(0, np.int64)
            if len(short):
                ids, n, marked = self._paths(raw[spread(offsets[short], offsets[short + 1] - offsets[short])].tobytes().decode("utf-8", "surrogatepass"), lengths[short])
                odd = short[marked]
                sizes[short] = n
                flat.append(ids)
                places.append(np.repeat(short, n))
            for j in [*odd.tolist(), *own[lengths[own] > LONGEST_WORD].tolist()]:
                text = raw[offsets[j] : offsets[j + 1]].tobytes().decode("utf-8", "surrogatepass").replace(" ", SPACE)
                apart[j] = np.array(self.pieces.numbers(self.pieces.segment(text)), "<u4")
        for j, x in apart.items():
            sizes[j] = len(x)
            flat.append(x)
            places.append(np.full(len(x), j))
        return np.concatenate(flat)[np.argsort(np.concatenate(places), kind="stable")].astype("<u4"), sizes

    def _paths(self, joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in turn, how many each has, and which have to be segmented by themselves (they get none)."""
        n, longest = len(lengths), int(lengths.max())
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        code[code == 32] = ord(SPACE)
        at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        letters = np.full((n, longest), self.n_letters - 1, np.int32)
        letters[np.arange(longest) < lengths[:, None]] = np.where(self.letters[at] == code, at, self.n_letters - 1)
        last, back = np.full((n, longest + 1), -1, np.int32), np.zeros((n, longest + 1), np.int8)
        last[:, 0] = self.start
        for q in range(longest):
            rows = np.flatnonzero((lengths > q) & (last[:, q] >= 0))
            node = np.zeros(len(rows), np.int64)
            for p in range(q + 1, longest + 1):
                key = node * self.n_letters + letters[rows, p - 1]
                step = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
                met = self.steps[step] == key
                node = np.where(met, self.step_to[step], 0)
                piece = np.where(met, self.ends[node], -1)
                if p == q + 1:
                    piece = np.where(piece < 0, self.other, piece)
                able = np.flatnonzero((piece >= 0) & (last[rows, p] < 0))
                able = able[self._fits(last[rows[able], q].astype(np.int64), piece[able])]
                last[rows[able], p], back[rows[able], p] = piece[able], q
                on = met & (lengths[rows] > p)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
        odd = (last[np.arange(n), lengths] < 0) | (last == self.other).any(axis=1)
        backwards, place = np.full((n, longest), -1, np.int32), np.where(odd, 0, lengths)
        for t in range(longest):
            rows = np.flatnonzero(place)
            if not len(rows):
                break
            backwards[rows, longest - 1 - t] = last[rows, place[rows]]
            place[rows] = back[rows, place[rows]]
        taken = backwards >= 0
        return backwards[taken], taken.sum(axis=1), odd

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pieces fit after which."""
        keys = before * len(self.strings) + piece + 1
        slot = ((keys * 0x9E3779B1) >> 12) & (MEMORY - 1)
        known, todo = np.full(len(keys), -1, np.int8), np.arange(len(keys))
        while len(todo):
            there = self.pairs[slot[todo]]
            hit = there == keys[todo]
            known[todo[hit]] = self.fitting[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
            slot[todo] = (slot[todo] + 1) & (MEMORY - 1)
        new = np.flatnonzero(known < 0)
        if len(new):
            pairs, which = np.unique(keys[new], return_inverse=True)
            fine = np.array([self.pieces._compatible(*map(self.strings.__getitem__, divmod(k - 1, len(self.strings)))) for k in pairs.tolist()])
            known[new] = fine[which]
            self._remember(pairs, fine)
        return known > 0

    def _remember(self, pairs: np.ndarray, fine: np.ndarray) -> None:
        if self.n_pairs + len(pairs) > MEMORY // 2:
            self.pairs[:], self.n_pairs = 0, 0
        pairs, fine = pairs[: MEMORY // 2], fine[: MEMORY // 2]
        self.n_pairs += len(pairs)
        slot = ((pairs * 0x9E3779B1) >> 12) & (MEMORY - 1)
        while len(pairs):  # of those that meet at an empty place one stays; the others go on
            free = np.flatnonzero(self.pairs[slot] == 0)
            self.pairs[slot[free]] = pairs[free]
            self.fitting[slot[free[self.pairs[slot[free]] == pairs[free]]]] = fine[free[self.pairs[slot[free]] == pairs[free]]]
            left = self.pairs[slot] != pairs
            pairs, fine, slot = pairs[left], fine[left], (slot[left] + 1) & (MEMORY - 1)


class Reader:
    """What ids read as."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.control = [model.is_control(i) for i in range(len(self.names))]
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.names) if model.is_byte(i)}
        self.unknown = model.unk_id()
        # where what an id reads as depends on its neighbours or is nothing, it is slow
        self.reads = [chr(self.byte_of[i]) if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.names)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(self.names))]
        self.slow = np.array([s and self.byte_of.get(i, 128) >= 128 for i, s in enumerate(special)])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, bytes read as UTF-8, the first space dropped. Control ids have no text."""
        if not self.slow[ids].any():
            return "".join(map(self.reads.__getitem__, ids.tolist())).removeprefix(" ")
        out: list[str] = []
        raw = bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(" ⁇ " if i == self.unknown else "" if self.control[i] else self.names[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text.removeprefix(" ")


def pieces(path: str) -> Pieces:
    """A task's vocabulary."""
    return coder(path).pieces


def reader(path: str) -> Reader:
    """A task's reader of ids."""
    return kept(("reader", path), lambda: Reader(path))


def coder(path: str) -> PieceCoder:
    """A task's coder; Python workers keep it until another operator's memory takes its place."""
    return kept(("pieces", path), lambda: PieceCoder(path))
