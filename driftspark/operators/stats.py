"""Binned statistics: grids, polygons, ages, running means, connectivity.

Each is one aggregation over filtered rows, partial before its shuffle.  Small dimension tables (polygons'
edges, groups' centres) are joined by hash or by a key of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions import alive, bin_of, degrees_per_metre, within


def gridded(obs: DataFrame, keys: list[Column | str], x: tuple, y: tuple, z: tuple | None = None, props: list[str] = (), where: Column | None = None) -> DataFrame:
    """Counts (and sums and means of props) by keys and cells; axes are (column, start, width, number of cells)."""
    axes = {"c": x, "r": y} | ({"k": z} if z else {})
    rows = obs.where(where) if where is not None else obs
    for col, start, width, n in axes.values():
        rows = rows.where(within(col, start, start + width * n))
    cells = [bin_of(col, start, width).alias(name) for name, (col, start, width, _) in axes.items()]
    total = lambda p: F.sum(F.col(p).cast("double"))
    sums = [s for p in props for s in (total(p).alias(f"sum_{p}"), F.try_divide(total(p), F.count(p)).alias(f"mean_{p}"))]
    return rows.groupBy(*keys, *cells).agg(F.count("*").alias("n"), *sums)


def alive_by(obs: DataFrame, *keys) -> DataFrame:
    return obs.where(alive()).groupBy(*keys).agg(F.count("*").alias("n_alive"))


def connectivity(counts: DataFrame, alive_counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.join(alive_counts, keys).withColumn("conn", F.try_divide(F.col("n"), F.col("n_alive")))


def group_polygons(obs: DataFrame, rings: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """obs with poly, the release group's polygon that holds each state, or -1: for connectivity from group to group."""
    from driftspark.operators.spatial import last_polygon

    edges = []
    for group, ring in sorted(rings.items()):
        closed = [*ring, ring[0]] if tuple(ring[0]) != tuple(ring[-1]) else ring
        edges += [(group, *p, *q) for p, q in zip(closed, closed[1:])]
    return obs.withColumn("poly", last_polygon(edges))


def running_mean(obs: DataFrame, start: int, update: int, k: int, *keys: str) -> DataFrame:
    """Mean count over blocks of k updates; updates without particles count as 0, blocks that aren't whole are dropped."""
    rows = obs.withColumn("nu", bin_of("t", start, update))
    span = rows.agg(F.min("nu").alias("a"), F.max("nu").alias("b")).select(
        F.ceil(F.col("a") / k).cast("long").alias("first"), (F.floor((F.col("b") + 1) / k) - 1).cast("long").alias("last")
    )
    counts = rows.groupBy(F.floor(F.col("nu") / k).cast("long").alias("blk"), *keys).agg(F.count("*").alias("n"))
    # the span is one row
    out = counts.join(F.broadcast(span), F.col("blk").between(F.col("first"), F.col("last")))
    return out.select("blk", *keys, (F.col("n") / F.lit(float(k))).alias("m"))


def released_so_far(obs: DataFrame, width: int) -> DataFrame:
    """Particles released by group, running over time bins."""
    first = obs.groupBy("id", "grp").agg(F.min("t").alias("t0")).groupBy("grp", bin_of("t0", 0, width).alias("nt")).agg(F.count("*").alias("n"))
    return first.select("grp", "nt", F.sum("n").over(Window.partitionBy("grp").orderBy("nt")).alias("released"))


def centred(obs: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Coordinates relative to the middle of the group's bounding box."""
    mid = obs.groupBy(group).agg(*[((F.min(v) + F.max(v)) / 2.0).alias(f"mid_{v}") for v in (x, y)])
    return obs.join(mid, group).select(obs["*"], (F.col(x) - F.col(f"mid_{x}")).alias(f"d{x}"), (F.col(y) - F.col(f"mid_{y}")).alias(f"d{y}"))


def cell_sizes(cells: DataFrame, x: tuple, y: tuple, z: tuple | None = None, geographic: bool = False, mode: str = "reference") -> DataFrame:
    """cells (r, c) with the area of each, in square metres (axes in degrees if geographic), and the volume of a layer's cell."""
    area = F.lit(float(x[2] * y[2]))
    if geographic:
        middle = y[1] + (F.col("r") + 0.5) * y[2]
        per_x, per_y = degrees_per_metre(middle, mode)
        area = F.abs(F.lit(float(x[2])) / per_x * F.lit(float(y[2])) / per_y)
    out = cells.withColumn("area", area)
    return out.withColumn("volume", F.col("area") * float(z[2])) if z else out


def limits(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[f(v).alias(f"{n}_{v}") for v in columns for n, f in (("min", F.min), ("max", F.max))])


def ftle(grid: DataFrame, lag: float, spacing: float = 1.0) -> DataFrame:
    """Finite-time Lyapunov exponents from end points (r, c, x, y) of a lattice, by central differences."""
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    d = grid.select("r", "c", *[
        F.when(F.lead(o).over(w) - F.lag(o).over(w) == 2, (F.lead(v).over(w) - F.lag(v).over(w)) / (2.0 * spacing)).alias(n)
        for n, v, w, o in (("fxx", "x", row, "c"), ("fxy", "x", col, "r"), ("fyx", "y", row, "c"), ("fyy", "y", col, "r"))
    ]).dropna()
    a, b, e = F.expr("fxx*fxx+fyx*fyx"), F.expr("fxx*fxy+fyx*fyy"), F.expr("fxy*fxy+fyy*fyy")
    largest = (a + e) / 2.0 + F.sqrt((a - e) * (a - e) / 4.0 + b * b)
    return d.where(largest > 0).select("r", "c", (F.ln(F.sqrt(largest)) / lag).alias("ftle"))
