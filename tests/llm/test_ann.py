"""NN-descent: recall against brute force, exact scores, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import ann

EMB = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, every, k):
    """{query: [(vec_id, score)]}: cosines in double precision, ties to smaller ids."""
    rows = [(i, np.array(v, float)) for i, v in rows]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        near = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in near]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    emb = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = emb.select("vec_id", F.col("embedding").cast("array<double>")).collect()
    want, got = brute([(r[0], r[1]) for r in rows], 50, 5), {}
    for r in ann.nearest(emb, every=50, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and q not in [i for i, _ in got[q].values()]
        true = dict(best)
        hits += sum(i in true for i, _ in got[q].values())
        for i, s in got[q].values():
            if i in true:
                assert s == pytest.approx(true[i], abs=1e-12)
        scores = [got[q][n][1] for n in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
    assert hits >= 0.95 * 5 * len(want)


def test_edge_cases(spark):
    rows = [
        (0, [1.0, 0.0], "x", 1), (1, [2.0, 0.0], "x", 1), (2, [0.0, 1.0], "x", 1), (3, [0.0, 0.0], "x", 1), (4, None, "x", 1), (5, [1.0, None], "x", 1),
        (6, [float("nan"), 1.0], "x", 1), (7, [float("inf"), 1.0], "x", 1), (8, [], "x", 1), (9, [1.0, 1.0, 1.0], "x", 1), (None, [1.0, 0.0], "x", 1), (50, [1.0, 0.0], "x", 1),
        (51, [1e300, 1e300], "x", 1), (100, [1.0, 2.0, 3.0], "x", 1), (1, [2.0, 0.0], "x", 1),
    ]
    emb = spark.createDataFrame(rows, EMB)
    got = {}
    for r in ann.nearest(emb, every=50, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    half = round(0.5**0.5, 9)
    assert got[0] == [(1, 1.0), (50, 1.0), (51, half), (2, 0.0)]
    assert got[50] == [(0, 1.0), (1, 1.0), (51, half), (2, 0.0)]
    assert [i for i, _ in got[100]] == [9]
    assert ann.nearest(emb.limit(0), every=50, k=5).collect() == []
    assert ann.nearest(emb.where("vec_id = 0"), every=50, k=5).collect() == []


def test_crowds_of_copies(spark):
    rng = np.random.default_rng(0)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same if i % 3 else rng.standard_normal(8).tolist()) for i in range(600)]
    got, want = {}, brute(rows, 50, 5)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    crowd = [q for q in want if q % 3]
    assert crowd and all(got[q] == {i for i in (1, 2, 4, 5, 7, 8) if i != q} - ({8} if q > 8 or q not in (1, 2, 4, 5, 7) else set()) for q in crowd)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("noise", [0.01, 0.003, 0.001])
def test_crowds_of_near_copies(spark, noise):
    """A third of all vectors is one vector with a little noise."""
    rng = np.random.default_rng(1)
    one = rng.standard_normal(64)
    x = [one + noise * rng.standard_normal(64) if i % 3 == 0 else rng.standard_normal(64) for i in range(3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = {}, brute(rows, 50, 5)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    crowd = [q for q in want if q % 3 == 0]
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in crowd) >= 0.9 * 5 * len(crowd)


def test_pools_grow_with_the_table():
    assert ann.grown(0) == ann.grown(1) == ann.grown(ann.MEASURED) == (256, 4)
    assert ann.grown(4 * ann.MEASURED) == (384, 5) and ann.grown(10**9)[0] > 1000
