"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into chunks of characters.  The state at a boundary is the piece that ends at it or reaches across it,
with how many of its characters lie before, so a chunk is a matrix of best scores from each state at its start to each
state at its end.  Matrices combine associatively by max-plus products, so chunks are measured independently and a
giant document does not wait for its start; once the states at the boundaries are known, each chunk is traced back by
itself.  In Spark the chunks of giant documents are rows of their own, dealt over all tasks; only their small matrices
meet by document.

Two kinds of models:

* Unigram (``Lattice``): a piece has a score, and the best sum wins.
* BPE (``Merges``; the public model at hand is one): merges are made in the order of their rank, which is not the best
  path of any sum of the pieces' scores.  But a sequence of pieces is what the merges make of a text if and only if
  they make of each two neighbours just these two.  So two neighbouring pieces score 0 if they stay as they are and
  minus infinity if they don't; one path of score 0 is left, and it is the text's encoding.  Runs of blanks are the
  exception, as their pieces have one score and merge from the left: a run is encoded by its length and never cut.

Words (what follows a blank, up to the next) are lattices of their own, since no piece reaches across their start.
The different words of a batch are searched together, place by place (``Batch``).

Edge cases.  Null text: null ids, and null text when decoded.  Empty text: no ids.  Characters outside the
vocabulary become bytes (BPE with byte fallback) or the unknown id.  Repeated rows each get their row.  A null doc_id
is kept.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Scratch, map_arrow, own_columns

#: Characters of a chunk.
CHUNK = 1 << 16
SPACE = "▁"
#: Words and pairs of pieces that a task remembers.
REMEMBERED = 200_000


class Lattice:
    """Pieces with scores; the scan over chunks of a text that is normalised already."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10 if unknown is None else unknown

    def edge(self, piece: str) -> float:
        """A piece's score; single characters outside the vocabulary have that of the unknown."""
        found = self.scores.get(piece)
        return found if found is not None else self.unknown if len(piece) == 1 else -math.inf

    def forward(self, text: str, a: int, b: int, state: int) -> tuple[np.ndarray, list[int]]:
        """Best scores of the boundaries from a - state to b, given a piece that begins at a - state, and where each best piece begins.

        Pieces may begin before a only at a - state, and none may end beyond b.
        """
        start = a - state
        best, back = np.full(b - start + 1, -math.inf), [-1] * (b - start + 1)
        best[0] = 0.0
        for end in range(a if state else a + 1, b + 1):
            if end == a and state:
                continue  # the piece reaches across a
            for begin in range(max(start, end - self.longest), end):
                if begin == start or begin >= a + (1 if state else 0):
                    value = best[begin - start] + self.edge(text[begin:end])
                    if value > best[end - start]:
                        best[end - start], back[end - start] = value, begin
        return best, back

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """[s, t]: best score from a piece boundary at a - s to one at b - t, with no other boundary in (a - s, a] if s
        and none in (b - t, b]."""
        n = self.longest
        out = np.full((n, n), -math.inf)
        for s in range(min(n, a + 1)):
            best, _ = self.forward(text, a, b, s)
            for t in range(n):
                if b - t > a or (b - t == a and s == 0):
                    out[s, t] = best[b - t - (a - s)]
            if s and b - a + s < n:  # the piece may go on through the whole chunk
                out[s, b - a + s] = max(out[s, b - a + s], 0.0)
        return out

    def encode(self, text: str, chunk: int = CHUNK) -> list[str]:
        """The best path's pieces."""
        if not text:
            return []
        chunk = max(chunk, self.longest)
        cuts = [*range(0, len(text), chunk), len(text)]
        states = path([self.transfer(text, a, b) for a, b in zip(cuts, cuts[1:])])
        out = []
        for (a, b), s, t in zip(zip(cuts, cuts[1:]), states, states[1:]):
            out += self.trace(text, a, b, s, t)
        return out

    def trace(self, text: str, a: int, b: int, s: int, t: int) -> list[str]:
        """A chunk's own pieces: those that end within it, on the best way from state s to state t."""
        if b - t <= a and (s or b - t < a):
            return []
        _, back = self.forward(text, a, b, s)
        out, at = [], b - t
        while at > a - s:
            begin = back[at - (a - s)]
            out.append(text[begin:at])
            at = begin
        return out[::-1]


class Table:
    """Integer keys to small values, looked up many at a time: open addressing in numpy."""

    def __init__(self, bits: int):
        self.bits, self.mask, self.count = bits, (1 << bits) - 1, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -3, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, key: int, value: int) -> None:
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.values[at] != -3 and int(self.keys[at]) != key:
            at = (at + 1) & self.mask
        self.count += self.values[at] == -3
        self.keys[at], self.values[at] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -3 where there is none."""
        at = self._place(keys)
        out = self.values[at]
        todo = np.flatnonzero((out != -3) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.values[at[todo]]
            todo = todo[(out[todo] != -3) & (self.keys[at[todo]] != keys[todo])]
        return out


#: Words that are searched together, and the longest of them.
TOGETHER, LONG = 50_000, 60
#: Bits of a piece's number, unknown characters (by code point) after the pieces.
NUMBER = 21


class Batch:
    """Paths of many words at once: the candidates for a word's next piece are checked for all words, place by place."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pieces = list(merges.scores)
        number = {p: i for i, p in enumerate(self.pieces)}
        self.lengths = np.array([len(p) for p in self.pieces] or [1])
        prefixes = {p[:n]: -1 for p in self.pieces for n in range(1, len(p) + 1)} | number
        self.prefixes = Table(max(16, (4 * len(prefixes)).bit_length()))
        for p, i in prefixes.items():
            h = 0
            for c in p:
                h = (h * 0xD6E8FEB86659FD93 + self._sign(ord(c))) & 0xFFFFFFFFFFFFFFFF
            self.prefixes.put(h, i)
        self.pairs = Table(21)

    @staticmethod
    def _sign(c):
        return (c + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF

    def text(self, piece: int) -> str:
        return self.pieces[piece] if piece < len(self.pieces) else chr(piece - len(self.pieces))

    def size(self, pieces: np.ndarray) -> np.ndarray:
        n = len(self.pieces)
        return np.where(pieces < n, self.lengths[np.minimum(pieces, n - 1)], 1)

    def candidates(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces that begin at each place; left: how many characters there are to the word's end."""
        signs = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        place, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        out = []
        for n in range(1, self.merges.longest + 1):
            h = h * np.uint64(0xD6E8FEB86659FD93) + signs[place + n - 1]
            found = self.prefixes.get(h)
            hit = found >= 0
            if n == 1:
                piece = np.where(hit, found, len(self.pieces) + code)
                out.append((place, np.ones(len(place), np.int64), piece))
            else:
                out.append((place[hit], np.full(int(hit.sum()), n), found[hit]))
            go = (found > -2) & (left[place] > n)
            place, h = place[go], h[go]
            if not len(place):
                break
        return tuple(np.concatenate(x) for x in zip(*out))

    def stay(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether neighbours stay as they are; pairs not seen before are merged once."""
        keys = (one.astype(np.uint64) << np.uint64(NUMBER)) | two.astype(np.uint64)
        got = self.pairs.get(keys)
        if (got == -3).any():
            if self.pairs.count > self.pairs.mask // 2:
                self.pairs = Table(self.pairs.bits)
                return self.stay(one, two)
            for key in np.unique(keys[got == -3]).tolist():
                a, b = self.text(key >> NUMBER), self.text(key & ((1 << NUMBER) - 1))
                self.pairs.put(key, int(self.merges.merged(a + b) == [a, b]))
            got = self.pairs.get(keys)
        return got > 0

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words (of at most LONG characters, with one leading blank at most), one after the other, and how many each has."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(start + size, size) - np.arange(len(code))
        place, length, piece = self.candidates(code, left)
        # the last piece of the path to each boundary; a word has one boundary more than characters
        first = start + np.arange(len(words))
        begin = place + word[place]
        end = begin + length
        reach = end - first[word[place]]
        order = np.argsort(reach, kind="stable")
        begin, end, piece, reach = begin[order], end[order], piece[order], reach[order]
        last = np.full(len(code) + len(words), -1)
        last[first] = -2
        cuts = np.searchsorted(reach, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            before = last[begin[a:b]]
            good = before == -2
            ask = np.flatnonzero(before >= 0)
            good[ask] = self.stay(before[ask], piece[a:b][ask])
            last[end[a:b][good]] = piece[a:b][good]
        at, live, steps = first + size, np.arange(len(words)), []
        live = live[size > 0]
        count = np.zeros(len(words), np.int64)
        while len(live):
            p = last[at[live]]
            steps.append((live, p))
            count[live] += 1
            at[live] -= self.size(p)
            live = live[at[live] > first[live]]
        out = np.empty(int(count.sum()), np.int64)
        ends = np.cumsum(count)
        for n, (rows, p) in enumerate(steps):
            out[ends[rows] - 1 - n] = p
        return out, count


#: A state before the first and after the last character of a text.
EDGE = (0, "")


class Merges:
    """A BPE model's pieces by score; the scan over chunks of a text that is normalised already."""

    def __init__(self, scores: dict[str, float]):
        if odd := [p for p in scores if SPACE in p[1:] and p.strip(SPACE)]:
            raise ValueError(f"a piece reaches across the start of a word: {odd[0]!r}")
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        joined = {c for p in scores if len(p) > 1 for c in p}
        # signs that are in no longer piece stand alone, so they part words as blanks do
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        self.words = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[{alone}]|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.alone = frozenset(chr(c) for c in range(128)) - joined
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[str]] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text: the best score first, of equal ones the leftmost."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(part):
                both = part[i] + part[j]
                if both in self.scores:
                    heapq.heappush(heap, (-self.scores[both], i, both))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or (j := right[i]) >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j], right[i] = both, None, right[j]
            if right[j] < len(part):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p is not None]

    def stay(self, one: str, two: str) -> bool:
        """Whether two neighbouring pieces stay as they are."""
        got = self.pairs.get((one, two))
        if got is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            got = self.pairs[one, two] = self.merged(one + two) == [one, two]
        return got

    def piece(self, text: str) -> bool:
        return len(text) == 1 or text in self.scores

    def breaks(self, text: str, at: int) -> bool:
        """Whether no piece reaches across this place, whatever is around it."""
        if not 0 < at < len(text):
            return True
        a, b = text[at - 1], text[at]
        return b == SPACE != a or a in self.alone or b in self.alone

    def forward(self, text: str, start: int, end: int, before: str) -> list[str]:
        """The last piece of the path from start, after the piece before, to each place up to end; none where there is no path."""
        last = [""] * (end - start + 1)
        for at in range(start + 1, end + 1):
            for begin in range(max(start, at - self.longest), at):
                piece = text[begin:at]
                if self.piece(piece):
                    one = before if begin == start else last[begin - start]
                    if (begin == start and not before) or (one and self.stay(one, piece)):
                        last[at - start] = piece
                        break
        return last

    def back(self, last: list[str], at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def word(self, word: str) -> list[str]:
        """A word's pieces; it may begin with blanks."""
        got = self.known.get(word)
        if got is None:
            blanks = len(word) - len(word.lstrip(SPACE))
            rest = word[max(0, blanks - 1) :]
            got = self.back(self.forward(rest, 0, len(rest), ""), len(rest))
            if blanks > 1 or rest == SPACE:
                run = blanks if got[0] == SPACE else blanks - 1
                got = self.merged(SPACE * run) + got[got[0] == SPACE :]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        """The pieces that may end at or reach across a place: (characters before it, piece).  A break has one state."""
        if self.breaks(text, at):
            return [EDGE]
        out = []
        for s in range(1, min(self.longest, at) + 1):
            if s > 1 and self.breaks(text, at - s + 1):
                break
            out += [(s, text[at - s : e]) for e in range(at, min(len(text), at - s + self.longest) + 1) if self.piece(text[at - s : e])]
        return out

    def first_break(self, text: str, a: int, b: int) -> int | None:
        return next((i for i in range(a, b + 1) if self.breaks(text, i)), None)

    def last_break(self, text: str, a: int, b: int) -> int | None:
        return next((i for i in range(b, a - 1, -1) if self.breaks(text, i)), None)

    def reach(self, text: str, a: int, state: tuple[int, str], end: int) -> tuple[int, list[str]]:
        """Where a state's piece ends, and the paths from there to each place up to end."""
        start = a - state[0] + len(state[1])
        return start, self.forward(text, start, max(start, end), state[1])

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """[i, j]: 0 if the i-th state at a and the j-th at b are on one path through the chunk, else minus infinity."""
        ins, outs = self.states(text, a), self.states(text, b)
        out = np.full((len(ins), len(outs)), -math.inf)
        stop, resume = self.first_break(text, a, b), self.last_break(text, a, b)
        if stop is not None:  # all meet there
            enter = [self._goes(*self.reach(text, a, s, stop), s, stop) for s in ins]
            leave = self.forward(text, resume, b, "")
            go_on = [t == EDGE or self._enters(leave, resume, "", b, t) for t in outs]
            out[np.ix_(enter, go_on)] = 0.0
            return out
        for i, s in enumerate(ins):
            start, last = self.reach(text, a, s, b)
            for j, t in enumerate(outs):
                same = b - t[0] == a - s[0] and t[1] == s[1]  # one piece reaches across the whole chunk
                if same or self._enters(last, start, s[1], b, t):
                    out[i, j] = 0.0
        return out

    def _goes(self, start: int, last: list[str], state: tuple[int, str], end: int) -> bool:
        return start == end or (start < end and bool(last[end - start]))

    def _enters(self, last: list[str], start: int, before: str, b: int, state: tuple[int, str]) -> bool:
        """Whether a path goes on with a state's piece."""
        at = b - state[0] - start
        if at < 0:
            return False
        one = before if at == 0 else last[at]
        return self.stay(one, state[1]) if one else at == 0

    def trace(self, text: str, a: int, b: int, s: int, t: int) -> list[str]:
        """A chunk's own pieces, those that begin within it, on the path from the s-th state at a to the t-th at b."""
        enter, leave = self.states(text, a)[s], self.states(text, b)[t]
        stop, resume = self.first_break(text, a, b), self.last_break(text, a, b)
        end = b - leave[0]
        tail = [leave[1]] if leave != EDGE and end >= a else []
        if stop is None:
            start, last = self.reach(text, a, enter, b)
            return (self.back(last, end - start) if end > start else []) + tail
        start, last = self.reach(text, a, enter, stop)
        out = self.back(last, stop - start) if stop > start else []
        for word in self.words.findall(text, stop, resume):
            out += self.word(word)
        return out + self.back(self.forward(text, resume, end, ""), end - resume) + tail

    def cuts(self, text: str, chunk: int) -> list[int]:
        """Places where chunks begin, and the end; a run of blanks is never cut."""
        out, at = [0], chunk
        while at < len(text):
            while at < len(text) and text[at] == SPACE and (text[at - 1] == SPACE or text[at + 1 : at + 2] == SPACE):
                at += 1
            # nor is the word that begins with the run's last blank parted from it
            while at < len(text) and text[at - 1] == SPACE:
                at += 1
            if at < len(text):
                out.append(at)
            at += chunk
        return [*out, len(text)]

    def encode(self, text: str, chunk: int = CHUNK) -> list[str]:
        """A text's pieces by chunks."""
        cuts = self.cuts(text, max(chunk, self.longest)) if text else [0, 0]
        spans = list(zip(cuts, cuts[1:]))
        states = path([self.transfer(text, a, b) for a, b in spans])
        return [p for (a, b), s, t in zip(spans, states, states[1:]) for p in self.trace(text, a, b, s, t)]


def combine(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product; associative, so any grouping gives the same."""
    return reduce(lambda x, y: (x[:, :, None] + y[None, :, :]).max(axis=1), matrices)


def path(matrices: list[np.ndarray]) -> list[int]:
    """The best path's state at each boundary, from the first to the last state 0."""
    prefixes = [np.where(np.arange(len(matrices[0])) == 0, 0.0, -math.inf)]
    for m in matrices:
        prefixes.append((prefixes[-1][:, None] + m).max(axis=0))
    states = [0]
    for m, before in zip(matrices[::-1], prefixes[:-1][::-1]):
        states.append(int(np.argmax(before + m[:, states[-1]])))
    return states[::-1]


class Codec:
    """A BPE model's file: its pieces and ids, read by the library, which does no encoding here."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.merges = Merges({model.id_to_piece(i): model.get_score(i) for i in plain})
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in size if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.strings = [b""] * len(size)
        for i in plain:
            self.strings[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.strings[i] = bytes([byte])
        self.strings[self.unknown] = " \u2047 ".encode()
        self.batch = Batch(self.merges)
        self.numbers_of = np.array([self.ids[p] for p in self.batch.pieces] or [0], np.int32)

    @staticmethod
    def normal(text: str) -> str:
        """Blanks as signs, one before the text."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def numbers(self, pieces: list[str]) -> array:
        out = array("i")
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are one chunk each, one after the other, and how many each has."""
        place: dict[str, int] = {}
        words, ends = array("q"), array("q")
        for text in texts:
            words.extend([place.setdefault(w, len(place)) for w in self.merges.words.findall(self.normal(text))])
            ends.append(len(words))
        flat, start, size = self._words(list(place))
        at = np.frombuffer(words, np.int64)
        each = size[at]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(start[at] - total[:-1], each) + np.arange(total[-1])]
        return ids, np.diff(total[np.frombuffer(ends, np.int64)], prepend=0)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, and where each one's begin and how many they are."""
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = [i for i, w in enumerate(words) if len(w) <= LONG and w != SPACE and w[:2] != SPACE * 2]
        others = set(range(len(words))).difference(plain)
        parts, at = [], 0
        for a in range(0, len(plain), TOGETHER):
            rows = np.array(plain[a : a + TOGETHER])
            pieces, count = self.batch.paths([words[i] for i in rows.tolist()])
            unknown = pieces >= len(self.numbers_of)
            parts.append(self.numbers_of[np.where(unknown, 0, pieces)])
            start[rows], size[rows] = at + np.cumsum(count) - count, count
            at += len(pieces)
            if unknown.any():  # unknown characters are bytes, so such words are put anew
                others.update(rows[np.unique(np.repeat(np.arange(len(rows)), count)[unknown])].tolist())
        for i in sorted(others):
            ids = self.numbers(self.merges.word(words[i]))
            parts.append(np.frombuffer(ids, np.int32))
            start[i], size[i] = at, len(ids)
            at += len(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), start, size

    def decode(self, ids) -> str:
        """Unknown bytes as the replacement sign; the blank before the text goes."""
        text = b"".join(map(self.strings.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def _codec(path: str) -> Codec:
    """The worker process's codec."""
    return Codec(path)


def _lists(flat: np.ndarray, lengths: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Lists of ids as an Arrow column."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(missing, False) if missing.any() else None)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


#: Rows of a batch that leaves a task.
ROWS = 2_000


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column("text").to_pylist()
                ids, count = codec.encode([t or "" for t in texts])
                yield pa.record_batch([batch.column("doc_id"), _lists(ids, count, np.array([t is None for t in texts]))], ["doc_id", "ids"])

    return run


CHUNKS = "doc_id long, digest string, copies long, k int, low int, high int, text string"


def _cut(path: str, size: int):
    """Chunks of giant texts, each with a piece's length of text around it: the chunk is text[low:high]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        room = 2 * codec.merges.longest + 2
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            for doc, digest, copies, text in zip(*(batch.column(n) for n in ("doc_id", "digest", "copies", "text"))):
                text = codec.normal(text.as_py())
                cuts = codec.merges.cuts(text, max(size, codec.merges.longest))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    start = max(0, a - room)
                    row = [doc.as_py(), digest.as_py(), copies.as_py(), k, a - start, b - start, text[start : b + room]]
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], names)

    return run


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _codec(path).merges
        for batch in batches:
            made = [merges.transfer(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(batch.column("text"), batch.column("low"), batch.column("high"))]
            cols = [pa.array([len(m) for m in made], pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())]
            yield pa.record_batch([*(batch.column(n) for n in ("doc_id", "digest", "k")), *cols], ["doc_id", "digest", "k", "n", "matrix"])

    return run


def _states(table: pa.Table) -> pa.Table:
    """The states at both ends of each chunk of a document."""
    table = table.sort_by("k")
    matrices = [np.frombuffer(m.as_py(), np.float64).reshape(n.as_py(), -1) for n, m in zip(table["n"], table["matrix"])]
    states = path(matrices)
    for name, values in (("s", states[:-1]), ("t", states[1:])):
        table = table.append_column(name, pa.array(values, pa.int32()))
    return table.select(["doc_id", "digest", "k", "s", "t"])


def _trace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("text", "low", "high", "s", "t")]
            ids = [codec.numbers(codec.merges.trace(*row)) for row in zip(*cols)]
            column = _lists(np.frombuffer(b"".join(x.tobytes() for x in ids), np.int32), np.array([len(x) for x in ids], np.int64), np.zeros(len(ids), bool))
            yield pa.record_batch([*(batch.column(n) for n in ("doc_id", "digest", "copies", "k")), column], ["doc_id", "digest", "copies", "k", "ids"])

    return run


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every row; path must be readable on the executors."""
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = map_arrow(docs.where(~giant), _encode(path), "doc_id long, ids array<int>")
    whole = docs.where(giant).groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    scratch = Scratch(docs.sparkSession, "sentencepiece")
    parts = scratch.put(map_arrow(whole, _cut(path, chunk), CHUNKS).repartition(F.xxhash64("digest", "k")))
    matrices = map_arrow(parts.select("doc_id", "digest", "k", "low", "high", "text"), _measure(path), "doc_id long, digest string, k int, n int, matrix binary")
    states = matrices.groupBy("doc_id", "digest").applyInArrow(_states, "doc_id long, digest string, k int, s int, t int")
    states = states.withColumnsRenamed({"doc_id": "of", "digest": "of_digest", "k": "of_k"})
    both = parts.join(states, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")) & (F.col("k") == F.col("of_k")))
    traced = map_arrow(both.select("doc_id", "digest", "copies", "k", "low", "high", "text", "s", "t"), _trace(path), "doc_id long, digest string, copies long, k int, ids array<int>")
    ordered = traced.groupBy("doc_id", "digest", "copies").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda x: x["ids"]))
    again = ordered.select("doc_id", ids.alias("ids"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return small.union(again.select("doc_id", "ids"))


def _values(column: pa.Array) -> Iterator[np.ndarray | None]:
    """A list column's rows."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield flat[offsets[i] : offsets[i + 1]] if column[i].is_valid else None


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            texts = [codec.decode(x.tolist()) if x is not None else None for x in _values(batch.column("ids"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids)."""
    return map_arrow(encoded.select("doc_id", "ids"), _decode(path), "doc_id long, text string")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _values(batch.column("ids"))):
                if ids is None:
                    rows.append((doc, None, None, None))
                else:
                    rows.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(codec.decode(ids.tolist()).encode())))
            kinds = [pa.int64()] * 4
            cols = zip(*rows) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_ids", "ids_crc32", "text_crc32"])

    return run


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_crc32): of the ids as unsigned 32-bit numbers, and of the decoded text as UTF-8."""
    return map_arrow(encoded.select("doc_id", "ids"), _digest(path), "doc_id long, n_ids long, ids_crc32 long, text_crc32 long")
