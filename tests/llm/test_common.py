"""Components, runs of keys, scratch tables."""

import random

import pyarrow as pa
import pytest

from driftspark.llm.common import Scratch, components, fresh, groups, own_columns, scratch_root


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)] + [(2000, 2001 + i) for i in range(100)]
    low = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "test")).collect()}
    assert all(got.get(x, x) == r for x, r in low.items()) and all(r < x or r == x for x, r in got.items())
    assert components(df.limit(0), Scratch(spark, "test")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_never_cut_a_run(size):
    keys = [0, 0, 1, 2, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    table = pa.table({"k": keys, "v": list(range(len(keys)))})
    runs = list(groups(iter(table.to_batches(max_chunksize=size)), ["k"]))
    assert [v for t in runs for v in t["v"].to_pylist()] == list(range(len(keys)))
    ends = [t["k"].to_pylist() for t in runs]
    assert all(a[-1] != b[0] for a, b in zip(ends, ends[1:]))


def test_fresh():
    assert fresh("x", ["y"]) == "x" and fresh("x", ["X", "x_"]) == "x__"


def test_own_columns(spark):
    df = spark.createDataFrame([(1, "a", 2)], "Doc_ID long, TEXT string, x int")
    assert own_columns(df, "doc_id", "text").collect() == [(1, "a")] and own_columns(df, "doc_id", "text").columns == ["doc_id", "text"]
    assert own_columns(df, "doc_id", "lang", optional=("lang",)).collect() == [(1, None)]
    with pytest.raises(ValueError, match="lang"):
        own_columns(df, "doc_id", "lang")


def test_scratch(spark):
    scratch = Scratch(spark, "test")
    one = scratch.put(spark.range(3))
    assert one.count() == 3 and scratch in Scratch.opened
    scratch.close()
    assert scratch not in Scratch.opened
    with pytest.raises(Exception):
        one.count()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session())
