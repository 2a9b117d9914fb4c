"""Nested grids: an outer mesh and finer ones in it.  Grids are corners() tables in order; the last that holds a point has it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators.spatial import locate as locate_in


def locate(points: DataFrame, grids: list[DataFrame], sizes: list[float]) -> DataFrame:
    """points (id, x, y, ...) with grid, tri and barycentric b0..b2, by the last grid that holds each; none are left out.

    Each grid is an equality join on cells; the grids' hits meet in one aggregation by id.
    """
    hits = [locate_in(points.select("id", "x", "y"), g, size).select("id", F.struct(F.lit(n).alias("grid"), "tri", "n0", "n1", "n2", "b0", "b1", "b2").alias("h")) for n, (g, size) in enumerate(zip(grids, sizes))]
    best = reduce(DataFrame.union, hits).groupBy("id").agg(F.max_by("h", F.col("h.grid")).alias("h"))
    return points.join(best, "id").select(points["*"], "h.*")


def route(points: DataFrame, grids: list[DataFrame], sizes: list[float]) -> DataFrame:
    """Where particles (id, x, y, grid) go on: into an inner grid that now holds them, out of one that they have left to the outer, else they stay where they were.

    moved_back: held by no grid at all, so that the last good place counts.
    """
    now = locate(points.select("id", "x", "y"), grids, sizes).select("id", F.col("grid").alias("_now"), "tri")
    out = points.join(now, "id", "left")
    return out.select(*[points[c] for c in points.columns if c != "grid"], F.coalesce("_now", "grid").alias("grid"), "tri", F.col("_now").isNull().alias("moved_back"))
