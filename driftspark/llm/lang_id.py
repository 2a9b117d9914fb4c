"""Language identification by cross-parsing entropy.

For each language the labelled text is kept as a suffix automaton.  A text is parsed greedily into the
longest phrases that occur in that language's text; few phrases mean that the text is well described by it
(Ziv and Merhav's cross parsing).  The language needing the fewest phrases, normalised by the size of its
automaton's text, wins.

Fit (on the driver, bounded).  ``rows`` labelled rows of each language, the first by a hash of doc_id and text, each
giving a window of at most ``window`` characters, up to ``chars`` characters in all.  A count by language
sets the share of hashes that is looked at; no more than ``rows`` rows a language reach the driver, whatever
repeats.  The automata have at most 2 * chars states.

Prediction (everywhere, whole texts).  Segments of ``SEGMENT`` letters and spaces of all texts of a batch advance
together through one transition table; a missing transition ends the phrase and starts the next one at the same
letter.  Where a text goes on in another segment, the parse of the one before is carried on until both begin a
phrase at one place, and the phrases up to there are counted anew: the counts are those of one parse of the whole
text, however it is cut.

Normal form: lower case, letters kept, each run of anything else one space.  The alphabet is the most
frequent letters of the fit; other letters share one sign.

Edge cases.  Null text or no letter: ``und``, score 0.  Nothing to learn from: ``und``, score 0, for all.
Equal phrase counts: the alphabetically first language.  A null doc_id counts as the empty text for the
split.  Repeated rows each get their row.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import column_of, crc_mod, map_arrow, own_columns

UNKNOWN = "und"
SEGMENT = 2048
#: Signs within which the parses of two segments are expected to meet; else the text is parsed by itself.
MEET = 256
#: Signs that the transition table knows: 0 space, 1 any other letter, the rest by frequency.
SIGNS = 64
#: Characters that are parsed at once.
BLOCK = 1 << 21


def normal(text: str) -> str:
    """Lower case; runs of anything but letters become one space; no space at the ends."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text over small integer signs."""

    def __init__(self, signs: list[int]):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in signs:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.nexts = nexts

    def phrases(self, signs: list[int]) -> int:
        """Greedy cross parsing, one sign at a time; for tests."""
        n, state = 0, None
        for c in signs:
            if state is not None and c in self.nexts[state]:
                state = self.nexts[state][c]
            else:
                n += 1
                state = self.nexts[0].get(c)
        return n


@dataclass
class Model:
    """langs in order; one transition table for all languages, its entries 2 * row + (1 if a phrase starts)."""

    langs: list[str]
    sizes: list[int]
    letters: str
    table: np.ndarray
    roots: np.ndarray

    def signs(self) -> np.ndarray:
        """Code point to sign, for the code points that the fit saw."""
        out = np.ones(0x110000, np.uint8)
        for i, c in enumerate(self.letters):
            out[ord(c)] = i + 2
        return out


def fit(samples: dict[str, list[str]], chars: int = 30_000) -> Model:
    """Automata of labelled texts; at most chars characters of each language are used."""
    joined = {}
    for lang in sorted(samples):
        parts, left = [], chars
        for text in samples[lang]:
            part = normal(text)[:left]
            if part:
                parts.append(part)
                left -= len(part) + 1
            if left <= 0:
                break
        if parts:
            joined[lang] = " ".join(parts)
    seen = Counter(c for text in joined.values() for c in text if c != " ")
    letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: SIGNS - 2])
    place = {c: i + 2 for i, c in enumerate(letters)} | {" ": 0}
    tables, roots, base = [], [], 0
    for text in joined.values():
        nexts = SuffixAutomaton([place.get(c, 1) for c in text]).nexts
        # one row more than there are states: the dead row, where every letter starts a phrase
        rows = np.zeros((len(nexts) + 1, SIGNS), np.int64)
        dead = len(nexts)
        start = np.full(SIGNS, dead, np.int64)
        for c, t in nexts[0].items():
            start[c] = t
        rows[:] = 2 * (base + start) + 1
        for s, out in enumerate(nexts):
            for c, t in out.items():
                rows[s, c] = 2 * (base + t)
        tables.append(rows)
        roots.append(base + dead)
        base += len(nexts) + 1
    table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.empty(0, np.int32)
    return Model(list(joined), [max(2, len(t)) for t in joined.values()], letters, table, np.array(roots, np.int32))


class Parser:
    """Counts phrases of many texts at once."""

    def __init__(self, model: Model):
        self.model, self.sign = model, model.signs()
        self.alpha: dict[int, bool] = {}
        self.kind = np.full(0x110000, 2, np.uint8)  # 0 other, 1 letter, 2 not looked at yet

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[codes]
        if (kind == 2).any():
            for c in np.unique(codes[kind == 2]).tolist():
                self.kind[c] = chr(c).isalpha()
            kind = self.kind[codes]
        letter = kind == 1
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first sign of a run of others stands for the run
        out = np.where(letter, self.sign[codes], 0)[keep].astype(np.uint8)
        return out[:-1] if len(out) and not letter[-1] else out

    def count(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases by language and text."""
        langs = len(self.model.langs)
        total = np.zeros((langs, len(texts)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        if not len(owner):
            return total
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = first[owner] + nth * SEGMENT, np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        flat = np.concatenate(texts)
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # how many are longer than t
        state = np.repeat(self.model.roots[:, None], len(owner), 1)
        counts = np.zeros((langs, len(owner)), np.int32)
        begins = np.zeros((langs, len(owner), min(MEET, int(size[0]))), bool)
        table, shift = self.model.table, SIGNS.bit_length() - 1
        for t in range(size[0]):
            n = active[t]
            sign = flat[start[:n] + t].astype(np.int32)
            got = table[(state[:, :n] << shift) + sign]
            counts[:, :n] += got & 1
            state[:, :n] = got >> 1
            if t < MEET:
                begins[:, :n, t] = got & 1
        for k in range(langs):
            total[k] = np.bincount(owner, counts[k], len(texts)).astype(np.int64)
        # segments that go on a text, and the segments before them
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        later = np.flatnonzero(nth > 0)
        here, before = place[later], place[later - 1]
        if not len(here):
            return total
        now, more = state[:, before], np.zeros((langs, len(here)), np.int64)
        met = np.zeros((langs, len(here)), bool)
        for t in range(begins.shape[2]):
            live = ~met & (t < size[here])
            if not live.any():
                break
            got = table[(now << shift) + flat[np.minimum(start[here] + t, len(flat) - 1)].astype(np.int32)]
            both = begins[:, here, t]
            more += np.where(live, (got & 1) - both, 0)
            met |= live & both & (got & 1 > 0)
            now = got >> 1
        for k in range(langs):
            np.add.at(total[k], owner[here], more[k])
            for text in np.unique(owner[here[~met[k] & (size[here] > MEET)]]).tolist():
                total[k, text] = self.alone(k, texts[text])
        return total

    def alone(self, lang: int, signs: np.ndarray) -> int:
        """Phrases of one text, sign by sign."""
        table, shift = self.model.table, SIGNS.bit_length() - 1
        state, n = int(self.model.roots[lang]), 0
        for c in signs.tolist():
            got = int(table[(state << shift) + c])
            n += got & 1
            state = got >> 1
        return n


def decide(model: Model, phrases: np.ndarray, length: int) -> tuple[str, float, float]:
    """Language, score, and bits a sign of the best language, from one text's phrase counts."""
    bits = phrases * np.log2(model.sizes)
    best = int(np.argmin(bits))
    # weights of the languages, as if the parses were codes, tempered as neighbouring phrases depend on each other
    score = 1 / float(np.sum(np.exp2(-np.minimum(1000, (bits - bits[best]) / math.sqrt(max(1, length))))))
    return model.langs[best], score, float(bits[best] / max(1, length))


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(broadcast.value)
        model = parser.model
        for batch in batches:
            texts = batch.column("text")
            langs, scores, bits = [], [], []
            at = 0
            while at < len(texts):
                chunk, used = [], 0
                while at < len(texts) and used < BLOCK:
                    chunk.append(parser.encode(texts[at].as_py() or ""))
                    used += len(chunk[-1])
                    at += 1
                counts = parser.count(chunk)
                for k, codes in enumerate(chunk):
                    if not model.langs or not len(codes):
                        lang, score, rate = UNKNOWN, 0.0, None
                    else:
                        lang, score, rate = decide(model, counts[:, k], len(codes))
                    langs.append(lang)
                    scores.append(score)
                    bits.append(rate)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())],
                ["doc_id", "lang_pred", "score", "bits"],
            )

    return run


def _with_language(broadcast, at: int, name: str):
    """The rows as they are, and the language of each."""
    predict = _predict(broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                text = batch.column(at)
                yield pa.record_batch([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])

        for made in predict(texts()):
            batch = held.pop()
            yield pa.record_batch([*batch.columns, made.column("lang_pred")], [*batch.schema.names, name])

    return run


def predict_column(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs, all columns, with the predicted language as a further last column."""
    own_columns(docs, "text")
    run = _with_language(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(column_of(docs, "text")), name)
    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def sample(docs: DataFrame, rows: int = 60, window: int = 2_000) -> dict[str, list[str]]:
    """Windows of labelled texts by language: the rows that come first by a hash of doc_id.

    docs: doc_id, text, lang.  Two jobs read the table: counts by language, then the chosen rows.
    """
    key = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30))
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", key.alias("key"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # half as many again as are wanted, so that chance leaves enough
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.5 * rows + 20) / n))])
    spare = F.greatest(F.length("text") - window, F.lit(0)) + 1
    windows = labelled.select("lang", "key", F.substring("text", (F.pmod(F.col("key"), spare) + 1).cast("int"), F.lit(window)).alias("text"))
    first = Window.partitionBy("lang").orderBy("key", "text")
    out: dict[str, list[tuple[int, str]]] = {}

    def gather(rows_of: DataFrame) -> None:
        for r in rows_of.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= rows).collect():
            out.setdefault(r.lang, []).append((r.key, r.text))

    gather(windows.where(F.col("key") < share[F.col("lang")] * float(1 << 30)))
    # rows that repeat share a hash, so chance may have left a language too few
    if few := [k for k, n in counts.items() if len(out.get(k, [])) < min(rows, n)]:
        for k in few:
            out.pop(k, None)
        gather(windows.where(F.col("lang").isin(few)))
    return {k: [t for _, t in sorted(v)] for k, v in sorted(out.items())}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, bits) of every row; bits a sign of the best parse, null for ``und``."""
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(docs, _predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, bits double")


def learn(docs: DataFrame, hold_out: bool = True, rows: int = 60, window: int = 2_000, chars: int = 30_000) -> Model:
    """A model of the labelled rows; hold_out: only of those whose crc32 of doc_id modulo 3 is not 1."""
    docs = own_columns(docs, "doc_id", "text", "lang", optional=("lang",)).select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return fit(sample(docs.where(crc_mod(F.col("doc_id"), 3) != 1) if hold_out else docs, rows, window), chars)


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits of every row of docs, learned from its own labelled rows."""
    out = predict(docs, learn(docs, **how))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "bits")
