"""URL filters: rules, and the model ratio against plain counting."""

import pytest
from pyspark.sql import functions as F

from driftspark.llm import url_filter

CASES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"), ("HTTPS://EXAMPLE.ORG/es/1?q#f", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://www.example.org/en/12", "www.example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://com/de/?x", "com", "/de/", "com/de/", "block"),
    ("http://xcom/de/", "xcom", "/de/", None, None), ("http://a.org", "a.org", "", None, None), ("http://a.org?x=/y", "a.org", "", None, None), ("http://a.net#/://b.org/", "a.net", "", None, None),
    (None, "", "", None, None), ("", "", "", None, None), ("no scheme", "", "", None, None), ("x://y://z/w", "y:", "//z/w", None, None), ("http://É.org/x", "É.org", "/x", "org/", "allow"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "t") for i, c in enumerate(CASES)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_scores_against_plain_counting(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = url_filter.judge(pages).collect()
    split = url_filter.parts(pages)
    rule, verdict = url_filter.rule_of(F.col("host"), F.col("path"))
    key = F.concat("host", F.substring("_rest", F.length("host") + 1, F.length("_rest")))
    plain = {r.page_id: r for r in split.select("page_id", key.alias("key"), verdict.alias("v"), (F.pmod(F.xxhash64(key), F.lit(10)) == 0).alias("held")).collect()}
    train = [(r.key, r.v) for r in plain.values() if r.v and not r.held]
    todo = [r for r in rows if r.score is not None]
    assert todo and len(rows) == len(plain)
    for r, want in zip(todo, url_filter.brute_force(train, [plain[r.page_id].key for r in todo])):
        assert r.score == pytest.approx(want, abs=1e-8)


def test_threshold_is_the_least_balanced_error():
    steps = [(-30, 1, 9), (-10, 2, 5), (0, 6, 3), (20, 9, 1)]
    errors = {e: sum(a for s, a, _ in steps if s < e) / 18 + sum(b for s, _, b in steps if s >= e) / 18 for e, *_ in steps}
    assert url_filter.threshold(steps) == min(errors, key=lambda e: (errors[e], abs(e))) * url_filter.SPAN / url_filter.STEPS
    assert url_filter.threshold([]) == url_filter.threshold([(1, 5, 0)]) == 0.0


def test_edges(spark):
    schema = "page_id long, url string, score int, verdict string"
    assert url_filter.judge(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, 1, "v"), (None, "http://a.net/", 1, "v"), (3, "http://a.net/" + "x" * 50000, 1, "v"), (4, "http://b.org/", 1, "v"), (4, "http://b.org/", 1, "v"), (5, "http://q.com/de/x", 1, "v")]
    got = url_filter.judge(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(rows[:5], schema)).collect()} == {"allow"}


def test_equal_urls_get_equal_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    seen = {}
    for r in url_filter.judge(pages.union(pages)).collect():
        seen.setdefault(r.page_id, set()).add((r.verdict, r.score))
    assert all(len(v) == 1 for v in seen.values())


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = url_filter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
