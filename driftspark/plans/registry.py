"""Queries by name, each with the SQL that says the same in DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def r6(x: Column) -> Column:
    """Six decimals, by the same arithmetic in both engines."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def s6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def random_sql(seed: int, *keys: str) -> str:
    """What functions.uniform() says, in DuckDB."""
    text = " || '|' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(cast(('0x' || left(md5({text}), 13)) as bigint) / 4503599627370496.0)"


def normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {random_sql(seed, *keys)})) * cos(2 * 3.141592653589793 * {random_sql(seed + 1, *keys)}))"


def quoted(text: str) -> str:
    return f"'{text}'"


OBS = """(select event_id, user_id as id, cast(floor(epoch(ts)) as bigint) as t, value as x,
  cast(json_extract_string(props, '$.k') as integer) as y, -cast(json_extract_string(props, '$.k') as integer) / 10.0 as z,
  cast(case event_type when 'click' then 10 when 'view' then 6 when 'purchase' then 3 when 'signup' then 0 else -5 end as bigint) as status,
  user_id % 3 as grp from events)"""
AGED = f"(select *, t - min(t) over (partition by id) as age from {OBS})"
T0 = 1704067200


def bin_sql(x: str, start: float, width: float) -> str:
    return f"cast(floor(({x} - {start}) / {float(width)}) as bigint)"
