"""Exact top-k against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import exact_topk


def brute(rows, every, k):
    out = []
    for q, v in rows:
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def ints(v):
    return [int(np.floor(64 * np.float64(x))) for x in v]


@pytest.mark.parametrize("shards", [(8192, 4096), (50, 7)])
def test_against_all_products(spark, shards):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r[0], ints(r[1])) for r in emb.select("vec_id", F.col("embedding").cast("array<double>")).collect()]
    got = exact_topk.top_k(emb, 20, 20, *shards).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, 20)


def test_edge_cases(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, -0.01]), (2, [0.5, -0.01]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (20, [2.0, 2.0, 2.0]), (40, [0.0, 0.0]), (8, [])]
    emb = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<double>, score int, shard string")
    good = [(i, ints(v)) for i, v in rows if i not in (3, 4, 5, 6, None)]
    assert sorted(map(tuple, exact_topk.top_k(emb, 20, 20, 2, 2).collect())) == brute(good, 20, 20)
    assert exact_topk.top_k(emb.limit(0), 20, 20).collect() == []
    assert exact_topk.top_k(emb.where("vec_id = 1"), 20, 20).collect() == []


def test_large_components(spark):
    rows = [(0, [1e6, 3e6]), (1, [2e6 + 0.5, 1e6]), (2, [-1e6, 1e6]), (3, [1e6, 1e6 + 1])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_topk.top_k(emb, 20, 20).collect())) == brute([(i, ints(v)) for i, v in rows], 20, 20)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(200)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_topk.top_k(emb, 20, 20, 30, 5).collect())) == brute([(i, ints(v)) for i, v in rows], 20, 20)


def test_boxes_bound_their_leaves():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((500, 6)) * 40)
    shard = exact_topk.Shard(np.arange(500), x, 32)
    assert sorted(shard.ids.tolist()) == list(range(500))
    q = np.floor(rng.standard_normal(6) * 40)
    bound = np.maximum(q, 0) @ shard.high.T + np.minimum(q, 0) @ shard.low.T

    def below(node):
        kids = shard.children[node]
        return [shard.at[node]] if not kids else [x for kid in kids for x in below(kid)]

    leaves = 0
    for node in range(len(shard.children)):
        rows = np.concatenate([np.arange(a, a + n) for a, n in below(node)])
        leaves += not shard.children[node]
        assert (shard.x[rows] @ q).max() <= bound[node] and shard.ids[rows].min() == shard.least[node]
        assert (shard.x[rows].min(0) == shard.low[node]).all() and (shard.x[rows].max(0) == shard.high[node]).all()
        for kid in shard.children[node] or ():
            assert bound[kid] <= bound[node]
    assert leaves == 16 and len(below(0)) == 16


@pytest.mark.parametrize("shards", [(8192, 4096), (10, 3)])
def test_repeated_rows(spark, shards):
    """Rows repeated more than k times, ids with two vectors and a repeated query: candidates and queries are rows."""
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(3, [9.0, 9.0])] * 12 + [(11, [8.0, 8.0])] * 3 + [(20, [1.0, 3.0]), (40, [0.0, 0.0])]
    emb, k = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10
    made = [(i, ints(v)) for i, v in rows]
    want = []
    for q in (0, 20, 40):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for p, v in made if p == q for i, w in made if i != q)[:k]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, exact_topk.top_k(emb, 20, k, *shards).collect())) == want
