"""Fields on meshes: vertical grids, staggered grids, cell to node, dry cells, derived fields.

A profile is an array over levels from the bottom up.  All are built-in expressions, joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions import c, friction_velocity, linear


def z_fractions(z, least: float = 0.25) -> Column:
    """Interfaces as fractions of the depth they span; evenly spaced where that is less than least."""
    z = c(z)
    n, low = F.size(z), z[0]
    span = F.element_at(z, -1) - low
    return F.transform(z, lambda v, i: F.when(span < least, i / (n - 1)).otherwise(F.try_divide(v - low, span)))


def thinnest_bottom(profiles: DataFrame) -> DataFrame:
    """One row: the node (node, z) with the thinnest bottom layer, as a fraction of its depth."""
    dz = F.try_divide(F.col("z")[1] - F.col("z")[0], F.element_at("z", -1) - F.col("z")[0])
    return profiles.agg(F.min_by("node", F.struct(dz, "node")).alias("node"))


def layers_to_interfaces(layer, mid, level) -> Column:
    """Values at layers' middles to the levels between, linear; ends go on with the slope of the last two."""
    layer, mid, level = c(layer), c(mid), c(level)
    n = F.size(mid)

    def at(z: Column) -> Column:
        k = F.least(F.greatest(F.size(F.filter(mid, lambda m: m <= z)) - 1, F.lit(0)), n - 2)
        return linear(z, F.get(mid, k), F.get(mid, k + 1), F.get(layer, k), F.get(layer, k + 1))

    return F.transform(level, at)


def regrid(values, fraction, target) -> Column:
    """A profile at other fractions of the depth, linear, without going beyond its ends."""
    values, fraction, target = c(values), c(fraction), c(target)

    def at(s: Column) -> Column:
        k = F.least(F.greatest(F.size(F.filter(fraction, lambda v: v <= s)) - 1, F.lit(0)), F.size(fraction) - 2)
        s = F.least(F.greatest(s, fraction[0]), F.element_at(fraction, -1))
        return linear(s, F.get(fraction, k), F.get(fraction, k + 1), F.get(values, k), F.get(values, k + 1))

    return F.transform(target, at)


def zero_at_bottom(values, bottom) -> Column:
    """Zero at the bottom level and below."""
    return F.transform(c(values), lambda v, i: F.when(i <= c(bottom), F.lit(0.0)).otherwise(v))


def at_bottom(values, bottom) -> Column:
    return F.get(c(values), c(bottom))


def depth_mean(values, z) -> Column:
    """Trapezoids over the depth."""
    values, z = c(values), c(z)
    parts = F.transform(F.sequence(F.lit(0), F.size(z) - 2), lambda i: (F.get(values, i) + F.get(values, i + 1)) / 2.0 * (F.get(z, i + 1) - F.get(z, i)))
    return F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.element_at(z, -1) - z[0])


def gradient(values, z, z0: float = 0.0003) -> Column:
    """d/dz from each level to the next; the top has that below it; none where cells are no higher than z0."""
    values, z = c(values), c(z)

    def at(_: Column, i: Column) -> Column:
        k = F.least(i, F.size(z) - 2)
        dz = F.get(z, k + 1) - F.get(z, k)
        return F.when(dz > z0, F.try_divide(F.get(values, k + 1) - F.get(values, k), dz)).otherwise(0.0)

    return F.transform(values, at)


def bottom_friction(u, v, z, z0: float = 0.0003) -> Column:
    """Friction velocity from the speed at the level above the bottom."""
    return friction_velocity(F.get(c(u), F.lit(1)), F.get(c(v), F.lit(1)), F.get(c(z), F.lit(1)) - F.get(c(z), F.lit(0)), z0)


def u_to_psi(u: DataFrame, axis: str = "r", *keys: str) -> DataFrame:
    """(keys, r, c, val) at corners: the mean of the two values along an axis, masked ones as zero; axis c is for v."""
    # value i lies between corners i - 1 and i: give it to both
    both = F.explode(F.array(F.lit(0), F.lit(-1)))
    shared = u.withColumn("_d", both).withColumn(axis, F.col(axis) + F.col("_d"))
    return shared.groupBy(*keys, "r", "c").agg((F.sum(F.coalesce("val", F.lit(0.0))) / 2.0).alias("val"), F.count("*").alias("_n")).where("_n = 2").drop("_n")


def rho_to_psi(rho: DataFrame, *keys: str) -> DataFrame:
    """(keys, r, c, val) at corners: the mean of the four values about each that are not null."""
    step = lambda: F.explode(F.array(F.lit(0), F.lit(-1)))
    shared = rho.withColumn("_a", step()).withColumn("_b", step()).select(*keys, (F.col("r") + F.col("_a")).alias("r"), (F.col("c") + F.col("_b")).alias("c"), "val")
    return shared.groupBy(*keys, "r", "c").agg(F.avg("val").alias("val"), F.count("*").alias("_n")).where("_n = 4").drop("_n")


def cells_to_nodes(tri: DataFrame, node: DataFrame, value: DataFrame, least: float = 0.01, *keys: str) -> DataFrame:
    """(keys, node, val) from cells (keys, tri, val): inverse distances to the cells' centres as weights.

    Null cells are made good by the count of cells, not by their weight.
    """
    corner = tri.select("tri", F.explode(F.array("n0", "n1", "n2")).alias("node")).join(node.select("node", "x", "y"), "node")
    centre = corner.groupBy("tri").agg((F.sum("x") / 3.0).alias("cx"), (F.sum("y") / 3.0).alias("cy"))
    w = corner.join(centre, "tri").join(value, "tri", "inner" if keys else "left").withColumn("w", 1.0 / F.greatest(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), F.lit(least)))
    total = w.groupBy(*keys, "node").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("val")).alias("s"), F.count("*").alias("n"), F.count("val").alias("good"))
    return total.select(*keys, "node", F.try_divide(F.col("s") / F.col("total") * F.col("n"), F.col("good")).alias("val"))


def dry_cells(tri: DataFrame, water: DataFrame, least: float = 0.25, *keys: str) -> DataFrame:
    """(keys, tri, is_dry) from nodes (keys, node, tide, water_depth): dry where any corner is."""
    corner = tri.select("tri", F.explode(F.array("n0", "n1", "n2")).alias("node")).join(water, "node")
    return corner.groupBy(*keys, "tri").agg(F.bool_or(F.col("tide") + F.col("water_depth") < least).alias("is_dry"))


def dry_by_nodes(tri: DataFrame, flags: DataFrame, *keys: str) -> DataFrame:
    """(keys, tri, is_dry) from nodes (keys, node, dry): dry where any corner is."""
    corner = tri.select("tri", F.explode(F.array("n0", "n1", "n2")).alias("node")).join(flags, "node")
    return corner.groupBy(*keys, "tri").agg(F.bool_or(F.col("dry").cast("boolean")).alias("is_dry"))


def dry_by_levels(tri: DataFrame, profiles: DataFrame, least: float = 0.25, *keys: str) -> DataFrame:
    """(keys, tri, is_dry) from nodes' interfaces (keys, node, z, bottom): dry where the water of any corner is thinner than least."""
    thin = profiles.select(*keys, "node", (F.element_at("z", -1) - F.get("z", F.col("bottom")) < least).alias("dry"))
    return dry_by_nodes(tri, thin, *keys)


def ragged_to_interfaces(layer, bottom) -> Column:
    """Layers above a ragged bottom to interfaces: means of neighbours; the ends have the nearest layer's value, what lies below is null.

    layer: n values from the bottom up; interfaces: n + 1.
    """
    layer, bottom = c(layer), c(bottom)
    n = F.size(layer)

    def at(i: Column) -> Column:
        below, above = F.get(layer, i - 1), F.get(layer, i)
        return F.when(i < bottom, F.lit(None).cast("double")).when(i == bottom, above).when(i == n, below).otherwise((below + above) / 2.0)

    return F.transform(F.sequence(F.lit(0), n), at)


def layers_to_levels(layer, layer_at, level_at) -> Column:
    """Layers at fractions of a node's own depth to levels at others, linear, the ends with the slope of the last two."""
    return layers_to_interfaces(layer, layer_at, level_at)


def regrid_log(values, z, target, bottom=0, z0: float = 0.0003) -> Column:
    """A profile over interfaces z at fractions of the depth, linear but in the bottom cell, where velocities follow a logarithm."""
    values, z, target, bottom = c(values), c(z), c(target), c(bottom)
    low, high = F.get(z, bottom), F.element_at(z, -1)

    def at(s: Column) -> Column:
        q = low + s * (high - low)
        k = F.greatest(F.least(F.size(F.filter(z, lambda v: v <= q)) - 1, F.size(z) - 2), bottom)
        dz = F.get(z, k + 1) - F.get(z, k)
        part = F.when(dz > z0, F.try_divide(q - F.get(z, k), dz)).otherwise(0.0)
        rough = F.try_divide(F.lit(z0), dz)
        log = F.when(dz > z0, (F.ln(part + rough) - F.ln(rough)) / (F.ln(1.0 + rough) - F.ln(rough))).otherwise(0.0)
        w = F.when(k == bottom, log).otherwise(part)
        return (1 - w) * F.get(values, k) + w * F.get(values, k + 1)

    return F.transform(target, at)


def sigma_profile(profiles: DataFrame, node_of: DataFrame, levels: int) -> list[float]:
    """Fractions of a uniform grid: those of the chosen node (one row), re-interpolated to so many levels."""
    (row,) = profiles.join(F.broadcast(node_of), "node").select(z_fractions("z").alias("f")).head(1)
    f = list(row.f)
    at = [i * (len(f) - 1) / (levels - 1) for i in range(levels)]
    return [f[min(int(a), len(f) - 2)] + (a - min(int(a), len(f) - 2)) * (f[min(int(a), len(f) - 2) + 1] - f[min(int(a), len(f) - 2)]) for a in at]


def friction(kind: str, u, v, z=None, sigma1=None, tide=None, depth=None, bottom=None, z0: float = 0.0003, density: float = 1025.0) -> Column:
    """Friction velocity at a node: from the bottom cell of a sigma, S-layer or fixed grid, or (stress) from the stress u, v."""
    u, v = c(u), c(v)
    if kind == "stress":
        return F.sqrt(F.hypot(u, v) / density)
    if kind == "sigma":
        dz, k = c(sigma1) * F.greatest(F.abs(c(tide) + c(depth)), F.lit(0.1)), F.lit(1)
    else:
        k = c(bottom) + 1
        dz = F.get(c(z), k) - (F.get(c(z), c(bottom)) if kind == "slayer" else -c(depth))
    speed = F.hypot(F.get(u, k), F.get(v, k))
    value = 0.4 * speed / F.ln((dz + z0) / z0)
    return value if kind == "sigma" else F.when(dz > 0.1, value).otherwise(0.0)
