"""Every query of the library with SQL beside it: the same rows in Spark and in DuckDB."""

import glob
from pathlib import Path

import duckdb
import pytest

from driftspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns) and all(t != "void" for _, t in df.dtypes)
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    key = lambda r: tuple(repr(v) for v in r)
    assert sorted(map(key, rows)) == sorted(key([r[i] for i in at]) for r in got.fetchall())


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import sys; sys.path.insert(0, '/root/repo'.replace('/root/repo', sys.argv[1])); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parent.parent)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
