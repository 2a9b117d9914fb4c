"""The max-plus scan against a plain Viterbi search; the chunked BPE codec against the library."""

import random

import numpy as np
import pytest

from driftspark.llm import sentencepiece_scan as sp
from driftspark.llm.queries import piece_file


def viterbi(text: str, lattice: sp.Lattice) -> float:
    best = [0.0] + [-float("inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = max(best[a] + lattice.edge(text[a:end]) for a in range(max(0, end - lattice.longest), end))
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("chunk", [5, 7, 16, 1000])
def test_scan_finds_the_best_path(seed, chunk):
    rnd = random.Random(seed)
    vocabulary = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))): rnd.uniform(-9, -1) for _ in range(12)}
    lattice, text = sp.Lattice(vocabulary), "".join(rnd.choice("abc") for _ in range(90))
    pieces = lattice.encode(text, chunk)
    assert "".join(pieces) == text
    assert sum(map(lattice.edge, pieces)) == pytest.approx(viterbi(text, lattice))


def test_matrices_combine_in_any_grouping():
    lattice = sp.Lattice({"a": -1.0, "ab": -1.5, "b": -2.0, "bab": -2.5})
    text = "abbabababbabaab" * 3
    cuts = [0, 11, 23, 30, len(text)]
    m = [lattice.transfer(text, a, b) for a, b in zip(cuts, cuts[1:])]
    left = sp.combine([sp.combine(m[:2]), sp.combine(m[2:])])
    assert np.allclose(left, sp.combine(m)) and np.allclose(left[0, 0], viterbi(text, lattice))


TEXTS = ["", " ", "a", "hello world", "two  spaces   three", " lead", "trail ", "tab\tand\nline", "é ü 日本語 \U0001f600", "a b " * 500, "x" * 3000, "▁ ▁a", "\x00 b", "word " * 100 + "  end", " " * 40 + "x" + " " * 31]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file())


@pytest.mark.parametrize("size", [16, 17, 40, 10**9])
def test_chunks_encode_like_the_library(size, library):
    """Matrices, path and traces against the merges of the library, on texts cut wherever the chunks end."""
    codec = sp.Codec(piece_file())
    rnd = random.Random(size)
    texts = TEXTS + ["".join(rnd.choice("ab  \n▁é.") for _ in range(200)) for _ in range(30)]
    texts += ["".join(rnd.choice("thequickbrownoxjumpsvlazydg日本語01") for _ in range(300)) for _ in range(30)]
    texts += [" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 40))) for _ in range(20)) for _ in range(30)]
    for text in texts:
        want = library.encode(text)
        assert codec.numbers(codec.merges.encode(codec.normal(text), size)).tolist() == want, repr(text)
        assert codec.encode([text])[0].tolist() == want, repr(text)
        assert codec.decode(want) == library.decode(want), repr(text)


def test_many_words_at_once():
    """Each word's path against the merges themselves."""
    codec = sp.Codec(piece_file())
    rnd = random.Random(8)
    words = ["▁"[: rnd.randint(0, 1)] + "".join(rnd.choice("etaoinshr,.日é") for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    words = [w for w in words if w != "▁"]
    pieces, count = codec.batch.paths(words)
    at = 0
    for w, n in zip(words, count.tolist()):
        assert [codec.batch.text(p) for p in pieces[at : at + n].tolist()] == codec.merges.merged(w)
        at += n


def test_neighbours_that_stay_make_a_path_and_only_one():
    """Of all ways to part a word, those whose neighbours all stay are the merges' own."""
    rnd = random.Random(3)
    for _ in range(20):
        order = ["".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4))) for _ in range(10)]
        merges = sp.Merges({p: -float(i) for i, p in enumerate([*"abc", *dict.fromkeys(order)])})
        for _ in range(20):
            word = "".join(rnd.choice("abc") for _ in range(9))
            ways = [[]]
            for n in range(len(word)):
                ways = [w + [word[n]] for w in ways] + [[*w[:-1], w[-1] + word[n]] for w in ways if w]
            ways = [w for w in ways if all(map(merges.piece, w)) and all(merges.stay(a, b) for a, b in zip(w, w[1:])) and all(merges.merged(p) == [p] for p in w)]
            assert ways == [merges.merged(word)]


def test_bpe_matrices_combine_in_any_grouping():
    merges = sp.Codec(piece_file()).merges
    text = "▁" + "thequickbrownfoxjumpsoverthelazydog" * 6
    cuts = [0, 40, 77, 120, len(text)]
    m = [merges.transfer(text, a, b) for a, b in zip(cuts, cuts[1:])]
    assert min(m[1].shape) > 3
    left = sp.combine([sp.combine(m[:2]), sp.combine(m[2:])])
    assert np.array_equal(left, sp.combine(m)) and left.tolist() == [[0.0]]


@pytest.mark.parametrize("chunk", [16, 50, sp.CHUNK])
def test_query_shape_and_edges(spark, library, chunk):
    rows = list(enumerate(TEXTS)) + [(90, None), (None, "no id"), (1, " "), (None, "long " * 30), (None, "long " * 30), (7, "other text of the same id " * 9)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    encoded = sp.encode(docs, piece_file(), chunk)
    want = sorted(((i, None if t is None else library.encode(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    texts = sorted(((r.doc_id, r.text) for r in sp.decode(encoded, piece_file()).collect()), key=str)
    assert texts == sorted(((i, None if x is None else library.decode(x)) for i, x in want), key=str)
    assert sp.digests(encoded.limit(0), piece_file()).collect() == []
    assert sp.encode(docs.limit(0), piece_file()).collect() == []


def test_a_giant_document_is_many_rows(spark, library):
    """Five million characters: chunks are rows in several tasks."""
    text = "".join(f"word{i % 977} and日本{i}\n " for i in range(300_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = sp.encode(docs, piece_file()).collect()
    assert len(text) > 5_000_000 and r.ids == library.encode(text)


def test_documents_come_back(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = {r.doc_id: r.ids for r in sp.encode(docs, piece_file()).collect()}
    for r in docs.collect():
        assert ids[r.doc_id] == (None if r.text is None else library.encode(r.text))
