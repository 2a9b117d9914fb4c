"""SimHash: fingerprints against the contract, links against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftspark.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{doc: smallest doc it reaches} by all pairs."""
    low = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, x in fps:
            for j, y in fps:
                if (x ^ y).bit_count() <= 3 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprints():
    texts = ["", None, " \t\n", "one", "One two", "a b c", "A B C d", "é\u2003x y z", "w\x1cx y z", "x " * 5000, "\U0001f600 b c d e f", "A\u00c9B c d e"]
    for t in texts:
        assert simhash.fingerprint(simhash.shingle_hashes((t or "").encode())) == plain_fingerprint(t), repr(t)


@pytest.mark.parametrize("seed", range(10))
def test_two_halves_lose_no_link(spark, seed):
    rnd = random.Random(seed)
    fps = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = list(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    low = {x: x for x in fps}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for r in simhash.links(df, chunk=5 if seed % 2 else 100).collect():
        a, b = (int(np.int64(v).view(np.uint64)) for v in r)
        assert (a ^ b).bit_count() <= 3
        low[max(root(a), root(b))] = min(root(a), root(b))
    want = plain_components([(x, x) for x in fps])
    group = {}
    for x in fps:
        group.setdefault(root(x), set()).add(want[x])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want.values()))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    low = plain_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", low[i]) for i, x in fps}
    assert len(got) == len(fps) and len(set(low.values())) < len(low)


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (9, " \t"), (7, "some words of a text here"), (7, "some words of a text here"), (None, "some words of a text here"), (3, "x y " * 30000), (None, "all alone in this little world")]
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, component_id int, fp string")
    got = sorted(((r.doc_id, r.component_id, r.fingerprint == "0" * 16) for r in simhash.near_duplicates(docs, chunk=1).collect()), key=str)
    want = [(5, 4, True), (4, 4, True), (9, 4, True), (7, 7, False), (7, 7, False), (None, 7, False), (3, 3, False), (None, None, False)]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [4, 7, 7, None, 3, None]))
    assert kept.where(F.col("doc_id") == 7).count() == 2
