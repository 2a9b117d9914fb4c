"""Packing: ids against the library, whole and gapless sequences, capacities, how full they are."""

import random
import zlib

import numpy as np
import pytest

from driftspark.llm import packing
from driftspark.llm.queries import tokenizer_files


def test_fast_ids_are_those_of_the_file():
    files = tokenizer_files()
    encode, slow = packing.Encoder(*files), packing.Encoder(files[0])
    for c in range(0x300):
        for text in (chr(c), f"a{chr(c)}b", f" {chr(c)} {chr(c)}{chr(c)}1"):
            assert encode(text).tolist() == slow(text).tolist(), hex(c)
    rnd = random.Random(0)
    signs = [chr(c) for c in range(0x250)] + ["  ", "\n\n", "'s", "'LL", "<|endoftext|>", "日", "\u2003"]
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(60))
        assert encode(text).tolist() == slow(text).tolist(), repr(text)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_slow_parts_give_the_ids_of_the_whole(size):
    slow = packing.Encoder(tokenizer_files()[0]).slow
    rnd = random.Random(size)
    signs = ["a", "B1", " ", "  ", "\n", "\n\n", "\t", "日本", "é", "'s", "<|endoftext|>", "\u2003", "\x1c", "!", "\x85", "\U0001f600"]
    for _ in range(200):
        text = "".join(rnd.choice(signs) for _ in range(80))
        parts = packing.slow_parts(text, size)
        assert "".join(parts) == text
        ids = [i for part in parts for i in slow.encode(part, add_special_tokens=False).ids]
        assert ids == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_slow_tokenizer_is_loaded_when_needed():
    encode = packing.Encoder(*tokenizer_files())
    encode("plain text")
    assert encode._slow is None
    encode("日本")
    assert encode._slow is not None


def test_cuts():
    for n in range(1, 60):
        got = packing.cuts(n, 10)
        assert sum(x for _, x in got) == n and all(0 < x <= 10 for _, x in got)
        assert all(x == 10 for _, x in got[1:]) and [a for a, _ in got] == np.cumsum([0, *[x for _, x in got[:-1]]]).tolist()


@pytest.mark.parametrize("how", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(8))
def test_plan_keeps_every_capacity(seed, how):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 100): rnd.randint(1, 400) for _ in range(30)}
    bins = packing.plan(counts, 100, documents=12, attention=7000 if seed % 2 else 10_000, how=how) if max(counts) <= 83 or not seed % 2 else packing.plan({k: v for k, v in counts.items() if k <= 83}, 100, documents=12, attention=7000, how=how)
    placed = {}
    for b in bins:
        used = sum(length * each for length, _, each, _ in b.runs)
        assert used <= 100 and sum(each for *_, each, _ in b.runs) <= 12 and sum(length**2 * each for length, _, each, _ in b.runs) <= (7000 if seed % 2 else 10_000)
        at = 0
        for length, low, each, offset in b.runs:
            assert offset == at
            at += length * each
            for i in range(b.n):
                for j in range(each):
                    placed.setdefault(length, []).append(low + i * each + j)
    assert all(sorted(v) == list(range(len(v))) for v in placed.values())
    assert {k: len(v) for k, v in placed.items()} == ({k: v for k, v in counts.items() if k <= 83} if seed % 2 and max(counts) > 83 else counts)


def test_too_large_a_piece():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def check(rows, docs, size):
    """rows: packed pieces; docs: [(doc_id, ids)]."""
    assert len(rows) == sum(len(packing.cuts(len(ids), size)) for _, ids in docs)
    want = sorted((str(d), k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for d, ids in docs for k, (a, n) in enumerate(packing.cuts(len(ids), size)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), sum(r.length for r in rows) / size


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slow = packing.Encoder(tokenizer_files()[0])
    want = [(r.doc_id, [*slow(r.text or "").tolist(), 2]) for r in docs.collect()]
    n, least = check(packing.pack_documents(docs, tokenizer_files()).collect(), want, 1024)
    assert n <= 1.02 * least + 1


def test_edge_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "no id"), (3, "word " * 5000), (4, "<|endoftext|> 日本"), (5, "a"), (5, "a")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, length int, sequence_id string")
    slow = packing.Encoder(tokenizer_files()[0])
    check(packing.pack_documents(docs, tokenizer_files(), size=64).collect(), [(i, [*slow(t or "").tolist(), 2]) for i, t in rows], 64)
    assert packing.pack_documents(docs.limit(0), tokenizer_files()).collect() == []


def test_ids_are_kept_when_asked(spark):
    docs = spark.createDataFrame([(1, "some words " * 40)], "doc_id long, text string")
    for r in packing.pack_documents(docs, tokenizer_files(), size=16, keep_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
