"""Schedules and release groups: who is released when and where.  Random choices depend on ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark import enums
from driftspark.functions import c, uniform
from driftspark.operators.mesh import numbered
from driftspark.operators.spatial import inside, polygon_edges


def interval_steps(start: float, end: float, dt: float, interval: float | None) -> range:
    """The steps of each interval, rounded to whole steps (at least one), from start to end; 0: once; None: each step."""
    every = 1 if interval is None else max(1, round(interval / dt))
    return range(1) if interval == 0 else range(0, int(abs(end - start) / dt) + 1, every)


def interval_schedule(spark: SparkSession, start: float, end: float, dt: float, interval: float | None) -> DataFrame:
    """(nt, time_sec) of interval_steps()."""
    steps, sign = interval_steps(start, end, dt, interval), 1 if end >= start else -1
    rows = spark.range(steps.start, steps.stop, steps.step)
    return rows.select(F.col("id").alias("nt"), (F.col("id") * float(sign * dt) + float(start)).alias("time_sec"))


def nearest_step(t, start: float, dt: float) -> Column:
    """The step nearest to a time, halves to the even one."""
    return F.bround((c(t) - start) / dt).cast("long")


def flag_step(t, start: float, dt: float) -> Column:
    return F.floor(F.abs(c(t) - start) / dt).cast("long")


def pulses(points: DataFrame, steps: range, pulse_size: int, first: int = 0) -> DataFrame:
    """Each point (grp, pt, x, y, z) pulse_size times at each scheduled step, counted from first.

    Steps and copies are sequences that each point explodes, so that there is no join.
    """
    if not len(steps):
        return points.limit(0).withColumn("nt", F.lit(0).cast("long")).withColumn("copy", F.lit(0)).withColumn("pulse", F.lit(0).cast("long"))
    nt = F.explode(F.sequence(*[F.lit(v).cast("long") for v in (first, first + steps[-1], steps.step)]))
    return points.withColumn("nt", nt).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(pulse_size - 1)))).withColumn("pulse", F.col("nt"))


def grid_points(spark: SparkSession, rows: int, cols: int, span_x: float, span_y: float, cx: float, cy: float) -> DataFrame:
    """(pt, r, c, x, y) of a regular grid about a centre."""
    r, k = F.floor(F.col("id") / cols), F.col("id") % cols
    step = lambda span, n: span / max(1, n - 1)
    return spark.range(rows * cols).select(
        F.col("id").alias("pt"), r.alias("r"), k.alias("c"), (cx - span_x / 2 + k * step(span_x, cols)).alias("x"), (cy - span_y / 2 + r * step(span_y, rows)).alias("y")
    )


def polygon_points(spark: SparkSession, ring: list[tuple[float, float]], n: int, seed: int, pulse: int = 0, cycles: int = 20) -> DataFrame:
    """(pt, x, y): n random points in a polygon, the first of a numbered series in its box that fall inside."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    low_x, low_y, wide, high = min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)
    closed = [*ring, ring[0]]
    own = abs(sum(a * q - p * b for (a, b), (p, q) in zip(closed, closed[1:]))) / 2
    tries = int(n * wide * high / own * 2) + 50
    edges = polygon_edges(spark, [ring])
    for _ in range(cycles):
        drawn = spark.range(tries).select("id", (low_x + wide * uniform(seed, F.lit(pulse), "id", F.lit("x"))).alias("x"), (low_y + high * uniform(seed, F.lit(pulse), "id", F.lit("y"))).alias("y"))
        found = drawn.join(inside(drawn, edges, "id", max(high, 1e-9)).select("id"), "id")
        if found.count() >= n:
            return numbered(found, "id", "pt").where(F.col("pt") < n).select("pt", "x", "y")
        tries *= 2
    raise ValueError("too few points fall in the polygon")


def radius_points(points: DataFrame, radius: float, seed: int, even: bool = False) -> DataFrame:
    """Points moved by up to a radius: r = u * radius, or evenly over the disc."""
    u = uniform(seed, "pt", "copy", "nt", F.lit("r"))
    r, angle = radius * (F.sqrt(u) if even else u), 2 * 3.141592653589793 * uniform(seed, "pt", "copy", "nt", F.lit("a"))
    return points.withColumn("x", F.col("x") + r * F.cos(angle)).withColumn("y", F.col("y") + r * F.sin(angle))


def downstream(points: DataFrame, distance: float, u: str = "u", v: str = "v") -> DataFrame:
    """Points moved along the direction of the current; where it stands still they stay."""
    speed = F.hypot(u, v)
    return points.withColumn("x", F.col("x") + F.coalesce(F.try_divide(F.col(u) * distance, speed), F.lit(0.0))).withColumn(
        "y", F.col("y") + F.coalesce(F.try_divide(F.col(v) * distance, speed), F.lit(0.0))
    )


def vertical(tide, depth, surface: bool, bottom: bool, offset: float, z_min: float | None, z_max: float | None, u) -> Column:
    """The release depth: at the surface, else at the bottom, else at fraction u of what the limits leave."""
    tide, depth, u = c(tide), c(depth), c(u)
    if surface:
        return F.greatest(tide - offset, -depth)
    if bottom:
        return F.least(-depth + offset, tide)
    low = F.greatest(-depth, F.lit(z_min)) if z_min is not None else -depth
    high = F.least(tide, F.lit(z_max)) if z_max is not None else tide
    return low + u * (high - low)


def assign_ids(released: DataFrame, groups: int, points: int, copies: int) -> DataFrame:
    """Consecutive ids in order of step, group, point and copy; statuses and bookkeeping of a new particle.

    groups, points, copies: larger than any number of theirs, to put the four in one key.
    """
    key = ((F.col("nt") * groups + F.col("grp")) * points + F.col("pt")) * copies + F.col("copy")
    out = numbered(released.withColumn("_key", key.cast("long")), "_key", "id").drop("_key")
    return out.withColumn("status", F.lit(enums.MOVING)).withColumn("x0", F.col("x")).withColumn("y0", F.col("y"))


def run_span(groups: DataFrame, first: float, last: float, most: float | None = None) -> DataFrame:
    """One row (start, end): what the groups (start, end, max_age) need, within the hindcast."""
    end = F.least(F.max(F.col("end") + F.coalesce("max_age", F.lit(0.0))), F.lit(float(last)))
    out = groups.agg(F.greatest(F.min("start"), F.lit(float(first))).alias("start"), end.alias("end"))
    return out if most is None else out.withColumn("end", F.least(F.col("end"), F.col("start") + most))


def forecast_alive(released: DataFrame) -> DataFrame:
    """(t, alive) at each time that a count changes, from (t0, max_age, n)."""
    from pyspark.sql import Window

    change = released.select(F.explode(F.array(F.struct(F.col("t0").alias("t"), F.col("n").alias("d")), F.struct((F.col("t0") + F.col("max_age")).alias("t"), (-F.col("n")).alias("d")))).alias("q"))
    by_time = change.groupBy("q.t").agg(F.sum("q.d").alias("d"))  # a row for each release or end time, of which there are few
    return by_time.select("t", F.sum("d").over(Window.orderBy("t")).alias("alive"))
