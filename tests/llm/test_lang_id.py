"""Language ID: automata against plain search, the parallel parser against the automata, held-out accuracy."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftspark.llm import lang_id

DOCS = "doc_id long, text string, lang string, score double, held_out string"


def plain_phrases(text: str, source: str) -> int:
    """Longest matches by substring search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in source:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("seed", range(5))
def test_automaton_finds_longest_matches(seed):
    rnd = random.Random(seed)
    source, text = ("".join(rnd.choice("abc ") for _ in range(n)) for n in (200, 300))
    automaton = lang_id.SuffixAutomaton([ord(c) for c in source])
    assert automaton.phrases([ord(c) for c in text]) == plain_phrases(text, source)


def test_parser_counts_like_the_automata():
    samples = {"x": ["the cat sat on the mat and the dog ran"], "y": ["le chat est sur la table et le chien court"]}
    model = lang_id.fit(samples)
    parser = lang_id.Parser(model)
    texts = ["the dog sat on the table", "Le CHAT, 12 court!", "", "123 !!", "zzz " * 1000, "the mat " * 700]
    codes = [parser.encode(t) for t in texts]
    for text, code in zip(texts, codes):
        assert len(code) == len(lang_id.normal(text))
    counts = parser.count(codes)
    place = {c: i + 2 for i, c in enumerate(model.letters)} | {" ": 0}
    for k, lang in enumerate(model.langs):
        automaton = lang_id.SuffixAutomaton([place.get(c, 1) for c in lang_id.normal(samples[lang][0])])
        for i, text in enumerate(texts):
            signs = [place.get(c, 1) for c in lang_id.normal(text)]
            assert counts[k, i] == automaton.phrases(signs)


@pytest.mark.parametrize("segment, meet", [(16, 4), (50, 20), (300, 256)])
def test_counts_do_not_depend_on_segments(monkeypatch, segment, meet):
    monkeypatch.setattr(lang_id, "SEGMENT", segment)
    monkeypatch.setattr(lang_id, "MEET", meet)
    rnd = random.Random(segment)
    samples = {k: ["".join(rnd.choice(c) for _ in range(400))] for k, c in (("x", "abc "), ("y", "bcd "), ("z", "ab"))}
    model = lang_id.fit(samples)
    parser = lang_id.Parser(model)
    texts = ["".join(rnd.choice("abcd e") for _ in range(rnd.randint(0, 900))) for _ in range(60)] + ["ab" * 700, "a" * 999, "abc " * 300]
    counts = parser.count([parser.encode(t) for t in texts])
    place = {c: i + 2 for i, c in enumerate(model.letters)} | {" ": 0}
    for k, lang in enumerate(model.langs):
        automaton = lang_id.SuffixAutomaton([place.get(c, 1) for c in lang_id.normal(samples[lang][0])])
        assert [automaton.phrases([place.get(c, 1) for c in lang_id.normal(t)]) for t in texts] == counts[k].tolist()


def test_decisions_against_plain_parsing(spark):
    """The whole operator, its sample at hand, against longest matches by substring search; ties go to the first language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    taken = lang_id.sample(docs.where(lang_id.crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    joined = {k: " ".join(filter(None, map(lang_id.normal, v)))[:30_000].rstrip() for k, v in taken.items()}
    letters = lang_id.fit(taken).letters
    fold = lambda t: "".join(c if c == " " or c in letters else "?" for c in lang_id.normal(t))
    got = {r.doc_id: r.lang_pred for r in lang_id.identify(docs).collect()}
    for r in docs.limit(25).collect():
        text = fold(r.text or "")
        bits = [(plain_phrases(text, fold(joined[k])) * math.log2(max(2, len(joined[k]))), k) for k in sorted(joined)]
        assert got[r.doc_id] == (min(bits)[1] if text.strip() else "und")
    twins = [(1, "abc abd", "b", 0.0, ""), (2, "abc abd", "a", 0.0, ""), (3, "abd", None, 0.0, "")]
    same = spark.createDataFrame(twins, DOCS)
    assert {r.lang_pred for r in lang_id.identify(same, hold_out=False).collect()} == {"a"}


@pytest.mark.parametrize("ids", [None, 5])
def test_rows_with_one_id_are_a_bounded_sample(spark, ids):
    rows = [(ids, f"the cat number {i} sat on the mat", "en", 0.0, "") for i in range(500)] + [(ids, "le chat", "fr", 0.0, "")] * 300
    got = lang_id.sample(spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang"), rows=60)
    assert len(got["en"]) == 60 == len(got["fr"])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = lang_id.identify(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)


def test_edge_cases(spark):
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", 0.5, "x"), (2, "le chat est sur la table avec le chien", "fr", 0.5, "x"),
        (3, None, "en", 0.5, "x"), (4, "", None, None, None), (5, "12 -- !?", "fr", None, None), (6, "the dog " * 20000, None, None, None),
        (6, "the dog", None, None, None), (None, "le chien", None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    out = lang_id.identify(docs, hold_out=False).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[3] == got[4] == got[5] == [("und", 0.0)]
    assert {x[0] for x in got[6]} == {"en"} and got[None][0][0] == "fr" and got[1][0][0] == "en"
    assert lang_id.identify(docs.limit(0)).collect() == []
    alone = lang_id.identify(spark.createDataFrame([(1, "some words")], "doc_id long, text string")).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


def test_labels_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_id.learn(docs)
    a = {r.doc_id: r.lang_pred for r in lang_id.predict(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in lang_id.predict(docs.withColumn("lang", docs.source), model).collect()}
    assert a == b
