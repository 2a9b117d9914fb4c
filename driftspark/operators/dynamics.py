"""Movement as expressions and joins: Runge-Kutta steps, velocity modifiers, status changes.

The kernel that takes many steps at once is in ``kernel``; what it does to a particle, these say for a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark import enums
from driftspark.functions import bernoulli, c, normal
from driftspark.operators.kernel import STATE, Block, Rules, field_block, step_block  # noqa: F401
from driftspark.operators.spatial import interpolate, locate


# -- expressions

def euler(x, v, dt: float) -> Column:
    return c(x) + c(v) * dt


def runge_kutta(order: int, x: Column, y: Column, velocity: Callable[[Column, Column], tuple[Column, Column]], dt: float) -> tuple[Column, Column]:
    """One step of order 1, 2 or 4 through a velocity that is given as expressions."""
    u1, v1 = velocity(x, y)
    if order == 1:
        return x + u1 * dt, y + v1 * dt
    u2, v2 = velocity(x + u1 * (dt / 2), y + v1 * (dt / 2))
    if order == 2:
        return x + u2 * dt, y + v2 * dt
    if order != 4:
        raise ValueError("the order is 1, 2 or 4")
    u3, v3 = velocity(x + u2 * (dt / 2), y + v2 * (dt / 2))
    u4, v4 = velocity(x + u3 * dt, y + v3 * dt)
    return x + (u1 + 2 * u2 + 2 * u3 + u4) * (dt / 6), y + (v1 + 2 * v2 + 2 * v3 + v4) * (dt / 6)


def random_walk(a_h: float, dt: float, seed: int, *keys) -> tuple[Column, Column]:
    """Velocities that spread particles as a diffusivity does."""
    std = math.sqrt(2 * dt * a_h) / dt
    return std * normal(seed, *keys, F.lit("u")), std * normal(seed, *keys, F.lit("v"))


def vertical_walk(a_v, gradient, dt: float, seed: int, *keys) -> Column:
    """A random vertical velocity, and the drift that a changing diffusivity asks for."""
    return c(gradient) + F.sqrt(2 * dt * c(a_v)) / dt * normal(seed, *keys, F.lit("w"))


def terminal_velocity(w, speed, direction: int = 1) -> Column:
    return c(w) + direction * c(speed)


def resuspended(z, depth, friction, critical: float, dt: float, seed: int, *keys, z0: float = 0.0003) -> tuple[Column, Column]:
    """(z, status) of particles on the bottom: lifted where the friction velocity reaches the critical one."""
    k = 2 * 0.4 * z0 * dt / (1 - 2 / math.pi)
    lift = (F.col("status") == enums.ON_BOTTOM) & (c(friction) >= critical)
    up = -c(depth) + z0 + F.sqrt(k * c(friction)) * F.abs(normal(seed, *keys))
    return F.when(lift, up).otherwise(c(z)), F.when(lift, enums.MOVING).otherwise(F.col("status"))


def basic_resuspension(z, depth, friction, critical: float, a_v: float, dt: float, seed: int, *keys) -> tuple[Column, Column]:
    lift = (F.col("status") == enums.ON_BOTTOM) & (c(friction) >= critical)
    up = -c(depth) + math.sqrt(2 * dt * a_v) * F.abs(normal(seed, *keys))
    return F.when(lift, up).otherwise(c(z)), F.when(lift, enums.MOVING).otherwise(F.col("status"))


def split(state: DataFrame, p: float, seed: int, statuses: list[int], step: int, low: float = 0.0, high: float = math.inf) -> DataFrame:
    """State with a child of each chosen particle: age 0, numbered by its parent and step."""
    can = F.col("status").isin(statuses) & (F.col("age") >= low) & (F.col("age") <= high) & bernoulli(p, seed, "id", F.lit(step))
    own = state if "parent" in state.columns else state.withColumn("parent", F.lit(None).cast("long"))
    child = own.where(can).withColumn("parent", F.col("id")).withColumn("id", F.xxhash64("id", F.lit(step), F.lit("child"))).withColumn("age", F.lit(0.0))
    return own.unionByName(child)


def culled(p: float, seed: int, statuses: list[int], step: int) -> Column:
    return F.when(F.col("status").isin(statuses) & bernoulli(p, seed, "id", F.lit(step)), enums.DEAD).otherwise(F.col("status"))


def cull_rate(rate: float, dt: float) -> float:
    """The chance to die within a step."""
    return rate * dt if rate * dt <= 1e-3 else 1 - math.exp(-rate * dt)


def stranded(status, dry) -> Column:
    """Dry cells strand what isn't dead; wet ones free it."""
    status = c(status)
    return F.when((status >= enums.STATIONARY) & (c(dry) > 128), enums.STRANDED).when((status == enums.STRANDED) & (c(dry) <= 128), enums.MOVING).otherwise(status).cast("long")


def settled(status, inside: Column, chosen: Column, since, duration: float) -> Column:
    """Moving particles settle in a polygon; settled ones move again after a while."""
    status = c(status)
    return F.when((status == enums.MOVING) & inside & chosen, enums.STATIONARY).when((status == enums.STATIONARY) & (c(since) >= duration), enums.MOVING).otherwise(status).cast("long")


def aged_out(status, age, most) -> Column:
    return F.when(F.abs(c(age)) > c(most), enums.DEAD).otherwise(c(status)).cast("long")


def boundary_response(search, status, use_open: bool) -> tuple[Column, Column]:
    """(whether to go back to the last good place, status) by the cell search's result."""
    search = c(search)
    back = search.isin([enums.HIT_DOMAIN, enums.HIT_DRY, enums.BAD_COORD, enums.FAILED]) | ((search == enums.HIT_OPEN) & F.lit(not use_open))
    return back, F.when((search == enums.HIT_OPEN) & F.lit(use_open), enums.OUTSIDE_OPEN).otherwise(c(status)).cast("long")


def surface_float(tide) -> Column:
    return c(tide)


def rheotaxis(u, v, speed: float, concentration: float, seed: int, *keys) -> tuple[Column, Column]:
    """Swimming against the current, its heading spread about that as a wrapped normal."""
    heading = F.atan2(-c(v), -c(u)) + normal(seed, *keys) / math.sqrt(concentration)
    return speed * F.cos(heading), speed * F.sin(heading)


# -- by joins

def step_by_joins(state: DataFrame, triangles: DataFrame, field: DataFrame, dt: float, size: float, order: int = 4, per_field: float = 1.0) -> DataFrame:
    """One step of all moving particles by joins alone, for fields too large to send: (id, nt, x, y, status).

    triangles: corners(); field: (nt, node, u, v); dt: seconds of a step, which is per_field steps of the field's; nt: in
    the field's steps.  Particles that leave the mesh on the way stay where they were.
    """

    def velocity(at: DataFrame, names: tuple[str, str]) -> DataFrame:
        """at: id, x, y, t in steps."""
        found = locate(at.select("id", "x", "y", "t"), triangles, size)
        out = None
        for name, f in zip(names, ("u", "v")):
            got = interpolate(found, field.select("node", "nt", F.col(f).alias("val")), "id").withColumnRenamed("val", name)
            out = got if out is None else out.join(got, "id")
        return out

    go = state.where(F.col("status") == enums.MOVING).select("id", F.col("x").alias("px"), F.col("y").alias("py"), "nt")
    parts = {1: (), 2: (0.5,), 4: (0.5, 0.5, 1.0)}[order]
    weights = {1: (1.0,), 2: (0.0, 1.0), 4: (1 / 6, 1 / 3, 1 / 3, 1 / 6)}[order]
    at = go.select("*", F.col("px").alias("x"), F.col("py").alias("y"), F.col("nt").cast("double").alias("t"))
    go = go.join(velocity(at, ("u0", "v0")), "id")
    for k, part in enumerate(parts, 1):
        at = go.select("id", (F.col("px") + part * dt * F.col(f"u{k - 1}")).alias("x"), (F.col("py") + part * dt * F.col(f"v{k - 1}")).alias("y"), (F.col("nt") + part * per_field).alias("t"))
        go = go.join(velocity(at, (f"u{k}", f"v{k}")), "id")
    move = [sum((w * F.col(f"{a}{k}") for k, w in enumerate(weights)), F.lit(0.0)) * dt for a in "uv"]
    moved = go.select("id", (F.col("px") + move[0]).alias("x"), (F.col("py") + move[1]).alias("y"))
    moved = locate(moved, triangles, size).select("id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    out = state.join(moved, "id", "left")
    return out.select("id", (F.col("nt") + 1).alias("nt"), F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), "status")
