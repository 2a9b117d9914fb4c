"""Hydrodynamic models' files to the library's tables.

There is no netCDF library here, so files come as Parquet dumps with the models' own names and shapes: a table for each
set of dimensions, vertical ones as arrays.  A reader takes those tables and gives a ``Hindcast``.

Tables by format (keys first):
 schism      node (node, SCHISM_hgrid_node_x, ..y, depth, node_bottom_index), face (face, SCHISM_hgrid_face_nodes), steps (time, node, zcor, hvel_x, hvel_y, vertical_velocity, elev)
 schism_v5   the same node and face, and a table for each of zCoordinates, horizontalVelX, horizontalVelY, verticalVelocity, elevation (time, node, value)
 roms        psi (r, c, lon_psi, lat_psi), rho (r, c, h, mask_rho), and by time zeta (rho), u, v (their own points), w (rho, at s_w); s_rho, s_w
 glorys      cell (r, c, longitude, latitude, deptho, deptho_lev), steps (time, r, c, uo, vo), depth (positive down)
 delft3d_fm  node (node, mesh2d_node_x, ..y), face (face, mesh2d_face_nodes), steps (time, face, mesh2d_ucx, mesh2d_ucy, mesh2d_ww1, mesh2d_s1, mesh2d_bldepth)
 fvcom       node (node, x, y, h, siglay, siglev), face (face, nv), nodes (time, node, zeta), cells (time, face, u, v, ww)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.operators import fields, kernel, mesh
from driftspark.sources import MAPPINGS, SIGNATURES, time_steps


@dataclass
class Hindcast:
    """node (node, x, y, depth, bottom), tri, field (nt, node, u, v, w, tide, z), and what the kernel wants to know of levels."""

    node: DataFrame
    tri: DataFrame
    field: DataFrame
    kind: str | None = None
    axis: list[float] | None = None
    dry: DataFrame | None = None
    open_nodes: DataFrame | None = None


def cells_of(face: DataFrame, nodes: str, first: int = 1) -> DataFrame:
    """(cell, n0..n3) from arrays of corners counted from first; a missing fourth corner is null, below first or equal to the third."""
    n = [F.get(nodes, F.lit(i)).cast("long") - first for i in range(4)]
    return face.select(F.col("face").alias("cell"), *[n[i].alias(f"n{i}") for i in range(3)], F.when((n[3] >= 0) & (n[3] != n[2]), n[3]).alias("n3"))


def stepped(df: DataFrame, time: str = "time") -> DataFrame:
    """With nt, the number of each time in order of content."""
    return df.join(F.broadcast(time_steps(df.select(time), time)), time).drop(time)  # a row for each step


def level_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, k, val): a row for each level of an array."""
    return df.select(*keys, F.posexplode(name).alias("k", "val"))


def level_arrays(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): arrays again, by level."""
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "val"))).alias("_v"))
    return held.select(*keys, F.transform("_v", lambda x: x["val"]).alias(name))


def whole(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def schism(node: DataFrame, face: DataFrame, steps: DataFrame, dry: DataFrame | None = None) -> Hindcast:
    """Interfaces that move (S-layers or LSC), quads and triangles; dry: (time, face, wetdry_elem) or, by nodes, (time, node, wetdry_node)."""
    m = MAPPINGS["schism"]
    cells = cells_of(face, "SCHISM_hgrid_face_nodes")
    split = mesh.split_quads(cells)
    bottom = (F.col("node_bottom_index") - 1).cast("long") if "node_bottom_index" in node.columns else F.lit(0).cast("long")
    out = node.select("node", F.col(m["x"]).alias("x"), F.col(m["y"]).alias("y"), F.col(m["water_depth"]).alias("depth"), bottom.alias("bottom"))
    clean = lambda n: F.transform(n, lambda v: F.coalesce(whole(v), F.lit(0.0)))
    lifted = F.transform("zcor", lambda v: F.coalesce(whole(v), F.array_min(F.transform("zcor", whole))))  # what lies below the bottom takes its height
    field = stepped(steps).select("nt", "node", clean("hvel_x").alias("u"), clean("hvel_y").alias("v"), clean("vertical_velocity").alias("w"), F.col("elev").alias("tide"), lifted.alias("z"))
    ground = field.join(out.select("node", "bottom"), "node")
    field = ground.select("nt", "node", *[fields.zero_at_bottom(n, "bottom").alias(n) for n in ("u", "v", "w")], "tide", "z")
    tri = split.select("tri", "n0", "n1", "n2")
    flags = None
    if dry is not None and "wetdry_node" in dry.columns:
        flags = fields.dry_by_nodes(tri, stepped(dry).select("nt", "node", (F.col("wetdry_node") > 0).alias("dry")), "nt")
    elif dry is not None:
        by_face = stepped(dry).select("nt", F.col("face").alias("cell"), (F.col("wetdry_elem") > 0).alias("is_dry"))
        flags = split.select("tri", "cell").join(by_face, "cell").select("nt", "tri", "is_dry")
    return Hindcast(out, tri, field, kernel.SLAYER, None, flags)


def schism_v5(node: DataFrame, face: DataFrame, **variables: DataFrame) -> Hindcast:
    """A table for each variable, joined by time and node."""
    names = {"zCoordinates": "zcor", "horizontalVelX": "hvel_x", "horizontalVelY": "hvel_y", "verticalVelocity": "vertical_velocity", "elevation": "elev"}
    steps = reduce(lambda a, b: a.join(b, ["time", "node"]), [variables[n].select("time", "node", F.col("value").alias(old)) for n, old in names.items()])
    return schism(node, face, steps)


def _psi(df: DataFrame, how, name: str, keys: list[str]) -> DataFrame:
    """Arrays on one of the staggered grids to corners."""
    rows = level_rows(df.select(*keys, "r", "c", name), [*keys, "r", "c"], name).withColumn("val", whole(F.col("val").cast("double")))
    return level_arrays(how(rows, *keys, "k"), [*keys, "r", "c"], name)


def roms(psi: DataFrame, rho: DataFrame, zeta: DataFrame, u: DataFrame, v: DataFrame, s_rho: list[float], s_w: list[float], w: DataFrame | None = None) -> Hindcast:
    """Sigma layers on an Arakawa-C grid: all to the corners and to the interfaces; rows and columns from 0.

    Corners on land (mask_rho 0 all around) are left out of cells as land; the outer rows and columns that aren't land are open.
    """
    cols = psi.agg(F.max("c") + 1).first()[0]
    rows = psi.agg(F.max("r") + 1).first()[0]
    number = (F.col("r") * cols + F.col("c")).alias("node")
    depth = fields.rho_to_psi(rho.select("r", "c", F.col("h").cast("double").alias("val"))).withColumnRenamed("val", "depth")
    wet = fields.rho_to_psi(rho.select("r", "c", F.col("mask_rho").cast("double").alias("val"))).withColumnRenamed("val", "wet")
    node = psi.join(depth, ["r", "c"]).join(wet, ["r", "c"]).select(number, F.col("lon_psi").alias("x"), F.col("lat_psi").alias("y"), "depth", (F.col("wet") == 0).alias("land"), "r", "c")
    quad = psi.where((F.col("r") < rows - 1) & (F.col("c") < cols - 1)).select((F.col("r") * (cols - 1) + F.col("c")).alias("cell"), (F.col("r") * cols + F.col("c")).alias("n0"))
    quad = quad.select("cell", "n0", (F.col("n0") + 1).alias("n1"), (F.col("n0") + cols + 1).alias("n2"), (F.col("n0") + cols).alias("n3"))
    kept = mesh.land_filter(quad, node.where("land").select("node"))
    tri = mesh.split_quads(mesh.numbered(kept, "cell", "rank").select(F.col("rank").alias("cell"), "n0", "n1", "n2", "n3")).select("tri", "n0", "n1", "n2")
    tide = fields.rho_to_psi(stepped(zeta).select("nt", "r", "c", whole(F.col("zeta").cast("double")).alias("val")), "nt").withColumnRenamed("val", "tide")
    mid, level = (F.array(*[F.lit(float(1 + s)) for s in a]) for a in (s_rho, s_w))
    parts = [tide.withColumn("tide", F.coalesce("tide", F.lit(0.0)))]
    for name, df, how in (("u", u, lambda d, *k: fields.u_to_psi(d, "r", *k)), ("v", v, lambda d, *k: fields.u_to_psi(d, "c", *k))):
        parts.append(_psi(stepped(df), how, name, ["nt"]).withColumn(name, fields.layers_to_interfaces(name, mid, level)))
    if w is not None:
        parts.append(_psi(stepped(w), fields.rho_to_psi, "w", ["nt"]).withColumn("w", F.transform("w", lambda x: F.coalesce(x, F.lit(0.0)))))
    field = reduce(lambda a, b: a.join(b, ["nt", "r", "c"]), parts)
    names = [n for n in ("u", "v", "w") if n in field.columns]
    zeroed = [fields.zero_at_bottom(n, F.lit(0)).alias(n) for n in names]
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == rows - 1) | (F.col("c") == cols - 1)
    open_nodes = structured_open(node, edge)
    return Hindcast(node.select("node", "x", "y", "depth"), tri, field.select("nt", number, *zeroed, "tide"), kernel.SIGMA, [1 + s for s in s_w], None, open_nodes)


def structured_open(node: DataFrame, edge: Column) -> DataFrame:
    """Nodes of the outer rows and columns that are not land."""
    return node.where(edge & ~F.col("land")).select("node")


def glorys(cell: DataFrame, steps: DataFrame, depth: list[float]) -> Hindcast:
    """Fixed levels: values of cells' centres to corners, depths downwards to heights upwards; land is null."""
    cols, rows, n = (int(x) for x in cell.agg(F.max("c"), F.max("r"), F.lit(len(depth))).first())
    number = (F.col("r") * cols + F.col("c")).alias("node")
    corner = lambda name: fields.rho_to_psi(cell.select("r", "c", whole(F.col(name).cast("double")).alias("val"))).withColumnRenamed("val", name)
    first = cell.withColumn("bottom", (n - F.coalesce("deptho_lev", F.lit(0))).cast("double"))
    deepest = first.withColumn("_a", F.explode(F.array(F.lit(0), F.lit(-1)))).withColumn("_b", F.explode(F.array(F.lit(0), F.lit(-1))))
    deepest = deepest.groupBy((F.col("r") + F.col("_a")).alias("r"), (F.col("c") + F.col("_b")).alias("c")).agg(F.min("bottom").alias("bottom"))
    node = reduce(lambda a, b: a.join(b, ["r", "c"]), [corner("longitude"), corner("latitude"), corner("deptho"), deepest])
    node = node.select(number, F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.coalesce("deptho", F.lit(0.0)).alias("depth"), F.least("bottom", F.lit(n - 2)).cast("long").alias("bottom"), F.col("deptho").isNull().alias("land"), "r", "c")
    quad = node.where((F.col("r") < rows - 1) & (F.col("c") < cols - 1)).select((F.col("r") * (cols - 1) + F.col("c")).alias("cell"), F.col("node").alias("n0"))
    quad = quad.select("cell", "n0", (F.col("n0") + 1).alias("n1"), (F.col("n0") + cols + 1).alias("n2"), (F.col("n0") + cols).alias("n3"))
    kept = mesh.land_filter(quad, node.where("land").select("node"))
    tri = mesh.split_quads(mesh.numbered(kept, "cell", "rank").select(F.col("rank").alias("cell"), "n0", "n1", "n2", "n3")).select("tri", "n0", "n1", "n2")
    timed = stepped(steps)
    names = {"uo": "u", "vo": "v"} | ({"wo": "w"} if "wo" in steps.columns else {})
    parts = [_psi(timed, fields.rho_to_psi, old, ["nt"]).withColumn(old, F.reverse(F.transform(old, lambda x: F.coalesce(x, F.lit(0.0))))) for old in names]
    field = reduce(lambda a, b: a.join(b, ["nt", "r", "c"]), parts).select("nt", number, *[F.col(old).alias(new) for old, new in names.items()], F.lit(0.0).alias("tide"))
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == rows - 1) | (F.col("c") == cols - 1)
    return Hindcast(node.select("node", "x", "y", "depth", "bottom"), tri, field, kernel.FIXED_Z, [-d for d in reversed(depth)], None, structured_open(node, edge))


def delft3d_fm(node: DataFrame, face: DataFrame, steps: DataFrame, layer_sigma: list[float], level_sigma: list[float]) -> Hindcast:
    """Cells' values to nodes by inverse distance, sigma layers to interfaces."""
    points = node.select("node", F.col("mesh2d_node_x").alias("x"), F.col("mesh2d_node_y").alias("y"))
    split = mesh.split_quads(cells_of(face, "mesh2d_face_nodes"))
    tri = split.select("tri", "n0", "n1", "n2")
    timed = mesh_cells(split, stepped(steps))
    flat = lambda name: fields.cells_to_nodes(tri, points, timed.select("nt", "tri", F.col(name).cast("double").alias("val")), 0.01, "nt")
    tide = flat("mesh2d_s1").withColumnRenamed("val", "tide")
    depth = flat("mesh2d_bldepth").where("nt = 0").select("node", (-F.col("val")).alias("depth"))
    mid, level = (F.array(*[F.lit(float(s)) for s in a]) for a in (layer_sigma, level_sigma))
    parts = [tide] + [_by_nodes(tri, points, timed, old, new).withColumn(new, fields.zero_at_bottom(fields.layers_to_interfaces(new, mid, level), F.lit(0))) for old, new in (("mesh2d_ucx", "u"), ("mesh2d_ucy", "v"), ("mesh2d_ww1", "w")) if old in steps.columns]
    field = reduce(lambda a, b: a.join(b, ["nt", "node"]), parts)
    return Hindcast(points.join(depth, "node"), tri, field, kernel.SIGMA, list(level_sigma))


def mesh_cells(split: DataFrame, by_face: DataFrame) -> DataFrame:
    """Values of faces for each of their triangles."""
    return split.select("tri", F.col("cell").alias("face")).join(by_face, "face").drop("face")


def _by_nodes(tri: DataFrame, points: DataFrame, timed: DataFrame, old: str, new: str) -> DataFrame:
    rows = level_rows(timed.select("nt", "tri", old), ["nt", "tri"], old)
    return level_arrays(fields.cells_to_nodes(tri, points, rows.withColumn("val", whole(F.col("val").cast("double"))), 0.01, "nt", "k"), ["nt", "node"], new)


def fvcom(node: DataFrame, face: DataFrame, nodes: DataFrame, cells: DataFrame) -> Hindcast:
    """Triangles; cells' velocities to nodes, then each node's own layers to its own levels; siglay and siglev from 0 at the surface to -1."""
    points = node.select("node", "x", "y")
    tri = face.select(F.col("face").alias("tri"), *[(F.get("nv", F.lit(i)).cast("long") - 1).alias(f"n{i}") for i in range(3)])
    up = lambda name: F.transform(F.reverse(name), lambda s: 1 + s)
    own = node.select("node", up("siglay").alias("mid"), up("siglev").alias("level"))
    timed = stepped(cells).withColumnRenamed("face", "tri")
    tide = stepped(nodes).select("nt", "node", F.col("zeta").alias("tide"))
    parts = [tide]
    for old, new in (("u", "u"), ("v", "v"), ("ww", "w")):
        at = _by_nodes(tri, points, timed.withColumn(old, F.reverse(old)), old, new).join(own, "node")
        parts.append(at.select("nt", "node", fields.zero_at_bottom(fields.layers_to_levels(new, "mid", "level"), F.lit(0)).alias(new)))
    field = reduce(lambda a, b: a.join(b, ["nt", "node"]), parts).join(node.select("node", "h", up("siglev").alias("level")), "node")
    z = F.transform("level", lambda s: -F.col("h") + s * (F.col("h") + F.col("tide")))
    return Hindcast(node.select("node", "x", "y", F.col("h").alias("depth")), tri, field.select("nt", "node", "u", "v", "w", "tide", z.alias("z")), kernel.SLAYER)


def generic(node: DataFrame, face: DataFrame, steps: DataFrame, names: dict[str, str], first: int = 1, kind: str | None = None, axis: list[float] | None = None) -> Hindcast:
    """Any unstructured model: names tells which column is x, y, depth, face_nodes, u, v, w, tide, z."""
    get = lambda df, wanted: df.select(*[F.col(names[n]).alias(n) for n in wanted if n in names and names[n] in df.columns])
    tri = mesh.split_quads(cells_of(face, names["face_nodes"], first)).select("tri", "n0", "n1", "n2")
    points = node.select("node", *[F.col(names[n]).alias(n) for n in ("x", "y", "depth") if n in names])
    timed = stepped(steps)
    field = timed.select("nt", "node", *get(timed, ("u", "v", "w", "tide", "z")).columns) if all(n in timed.columns for n in ("u", "v")) else timed.select("nt", "node", *[F.col(names[n]).alias(n) for n in ("u", "v", "w", "tide", "z") if n in names])
    return Hindcast(points, tri, field, kind, axis)


def subgrid(cell: DataFrame) -> DataFrame:
    """Nine points for each cell of a structured grid: its centre, its edges' middles and its corners: (r2, c2, val) on the grid of half steps.

    Points between cells have the mean of the cells about them that are not null.
    """
    near = cell.withColumn("_a", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_b", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    return near.groupBy((2 * F.col("r") + F.col("_a") + 1).alias("r2"), (2 * F.col("c") + F.col("_b") + 1).alias("c2")).agg(F.avg("val").alias("val"))


#: Readers by format; a format is known by its signature (sources.detect()).
READERS: dict[str, Callable[..., Hindcast]] = {"schism": schism, "schism_v5": schism_v5, "roms": roms, "glorys": glorys, "delft3d_fm": delft3d_fm, "fvcom": fvcom, "generic": generic}
if missing := set(SIGNATURES) - set(READERS):
    raise ImportError(f"no reader for {sorted(missing)}")


def rewrite(field: DataFrame, path: str, limits: dict[str, tuple[float, float]], steps_per_file: int, drop: tuple[str, ...] = (), first: int | None = None, last: int | None = None) -> None:
    """The field as a smaller table: values clipped and put into 16 bits, columns dropped, steps cut and laid out in folders of so many."""
    from driftspark.functions import quantize

    rows = field.drop(*drop)
    if first is not None or last is not None:
        rows = rows.where(F.col("nt").between(first if first is not None else -(1 << 62), last if last is not None else 1 << 62))
    kinds = dict(rows.dtypes)
    for name, (low, high) in limits.items():
        small = F.transform(name, lambda x: quantize(x, low, high)) if kinds[name].startswith("array") else quantize(name, low, high)  # noqa: B023
        rows = rows.withColumn(name, small)
    rows.withColumn("block", F.floor(F.col("nt") / steps_per_file)).repartition("block").write.mode("overwrite").partitionBy("block").parquet(path)


def unpacked(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """What rewrite() wrote, as numbers again."""
    from driftspark.functions import dequantize

    kinds = dict(rows.dtypes)
    for name, (low, high) in limits.items():
        rows = rows.withColumn(name, F.transform(name, lambda x: dequantize(x, low, high)) if kinds[name].startswith("array") else dequantize(name, low, high))  # noqa: B023
    return rows
