"""Queries through the step kernel in 3-D: layers, interpolation and every part of a step, each with its SQL.

The mesh is the lattice of the other queries, with a bottom, a tide and levels; the points are the embeddings', at depths
from their third component.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark import enums
from driftspark.operators import kernel, mesh
from driftspark.plans.meshes import LOC, built, located
from driftspark.plans.registry import query, r6, s6

DEPTH, TIDE = "(8.0 + node % 5)", "(0.1 * (node % 3) + 0.05 * nt)"
SIGMAS, LEVELS = [0.0, 0.05, 0.2, 0.5, 0.8, 1.0], [-20.0, -10.0, -5.0, -2.0, -1.0, 0.0]
FIELD = "((node % 7) * 1.5 + nt * 0.25 * (node % 3) + k * 0.1 * (node % 4))"
T = 0.5
Z = "(-12.0 * (t - 1))"
BOTTOM = "cast(case when node % 5 < 2 then 1 else 0 end as bigint)"
HEIGHT = f"(-{DEPTH} + [0.0, 0.05, 0.2, 0.5, 0.8, 1.0][k + 1] * ({DEPTH} + {TIDE}))"

#: The corners of each point's triangle with their weights.
NEAR = f"(select id, x, y, tri, {Z} as z, unnest([n0, n1, n2]) as node, unnest([b0, b1, b2]) as b from {LOC})"
WATER = f"""(select id, tri, x, y, z, sum(b * {DEPTH}) as depth, sum(b * ((1 - {T}) * {TIDE.replace('nt', '0')} + {T} * {TIDE.replace('nt', '1')})) as tide, min({BOTTOM}) as bottom from {NEAR} group by all)"""
ROUGH = "0.0003"
LOG = f"(ln({{zf}} + {ROUGH} / {{dz}}) - ln({ROUGH} / {{dz}})) / (ln(1 + {ROUGH} / {{dz}}) - ln({ROUGH} / {{dz}}))"
SIGMA_SQL = f"""(with w as (select *, least(greatest(z, -depth), tide) as q, greatest(abs(tide + depth), 0.25) as total from {WATER}),
  f as (select *, least(abs(q + depth) / total, 0.9999) as f from w), n as (select *, cast(least(len(list_filter({SIGMAS}, lambda s: s <= f)) - 1, 4) as integer) as nz from f),
  g as (select *, (f - {SIGMAS}[nz + 1]) / ({SIGMAS}[nz + 2] - {SIGMAS}[nz + 1]) as zf, nz = 0 and f < {ROUGH} / total as rest from n)
  select *, case when rest then 0.0 when nz = 0 then {LOG.format(zf='zf', dz='(0.05 * total)')} else zf end as zfv, case when rest then -depth else q end as zz, cast(case when rest then 6 else 10 end as bigint) as status from g)"""
STEPS = "(values (0, 0.5), (1, 0.5)) as m(nt, share)"


def block(spark, kind, **more):
    """Two steps of the fields."""
    node, _, tri = built(spark)
    node = node.withColumn("depth", F.expr(DEPTH).cast("double"))
    steps = node.select("node", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("nt"))
    levels = F.sequence(F.lit(0), F.lit(5))
    value = F.transform(levels, lambda k: F.expr(FIELD.replace("k *", "0.0 *")).cast("double") + k * 0.1 * (F.col("node") % 4))
    field = steps.select("nt", "node", value.alias("u"), value.alias("v"), value.alias("w"), F.expr(TIDE).cast("double").alias("tide"))
    if kind == kernel.SLAYER:
        sigmas = F.array(*[F.lit(s) for s in SIGMAS])
        field = field.withColumn("z", F.transform(sigmas, lambda s: -F.expr(DEPTH) + s * (F.expr(DEPTH) + F.expr(TIDE))))
    if kind != kernel.SIGMA:
        node = node.withColumn("bottom", F.expr(BOTTOM))
    for name, column in more.items():
        field = field.withColumn(name, column)
    axis = {kernel.SIGMA: SIGMAS, kernel.FIXED_Z: LEVELS}.get(kind)
    return kernel.field_block(node, tri.drop("cell"), mesh.adjacency(tri), field, 0, 1, 60.0, kind, axis)


def start(spark, sf, tri: bool = True):
    at = located(spark, sf)
    return at.select("id", F.lit(0).cast("long").alias("nt"), (F.col("tri") if tri else F.lit(-1).cast("long")).alias("tri"), "x", "y", (-12.0 * (F.col("t") - 1)).alias("z"), F.lit(enums.MOVING).cast("long").alias("status"))


def flat_block(spark, **arrays):
    """Still water, but for what is given."""
    b = block(spark, kernel.SIGMA)
    b.u, b.v, b.w = b.u * 0, b.v * 0, b.w * 0
    for name, value in arrays.items():
        setattr(b, name, value)
    return b


@query(f"select id, nz, {s6('zf')} as zf, {s6('zfv')} as zfv, {s6('zz')} as z, status, {s6('tide')} as tide, {s6('depth')} as water_depth from {SIGMA_SQL}")
def sigma_cell(spark, sf):
    """The layer of a sigma grid, logarithmic on the bottom."""
    out = kernel.evaluate(start(spark, sf), block(spark, kernel.SIGMA), T)
    return out.select("id", "nz", *[r6(F.col(n)).alias(n) for n in ("zf", "zfv", "z")], "status", *[r6(F.col(n)).alias(n) for n in ("tide", "water_depth")])


SLAYER_SQL = f"""(with h as (select n.id, k, sum(b * share * {HEIGHT.replace('k + 1', 'greatest(k, ' + BOTTOM + ') + 1')}) as h from {NEAR} n, {STEPS}, range(6) l(k) group by all),
  p as (select id, list(h order by k) as h from h group by 1), w as (select *, greatest(least(z, h[6]), h[bottom + 1]) as q from {WATER} join p using (id)),
  n as (select *, cast(greatest(least(len(list_filter(h, lambda v: v <= q)) - 1, 4), bottom) as integer) as nz from w),
  g as (select *, h[nz + 2] - h[nz + 1] as dz, case when h[nz + 2] - h[nz + 1] < {ROUGH} then 0.0 else (q - h[nz + 1]) / (h[nz + 2] - h[nz + 1]) end as zf, nz = bottom and q < h[nz + 1] + {ROUGH} as rest from n)
  select *, case when nz = bottom and dz < {ROUGH} then 0.0 when nz = bottom then {LOG.format(zf='zf', dz='dz')} else zf end as zfv, case when rest then h[nz + 1] else q end as zz, cast(case when rest then 6 else 10 end as bigint) as status from g)"""


@query(f"select id, nz, {s6('zf')} as zf, {s6('zfv')} as zfv, {s6('zz')} as z, status from {SLAYER_SQL}")
def slayer_cell(spark, sf):
    """The layer between interfaces that move, over a ragged bottom."""
    out = kernel.evaluate(start(spark, sf), block(spark, kernel.SLAYER), T)
    return out.select("id", "nz", *[r6(F.col(n)).alias(n) for n in ("zf", "zfv", "z")], "status")


FIXED_SQL = f"""(with w as (select *, least(greatest(z, -depth), tide) as q from {WATER}), n as (select *, cast(greatest(least(len(list_filter({LEVELS}, lambda v: v <= q)) - 1, 4), 0) as integer) as n0 from w),
  g as (select *, n0 <= bottom as bed, greatest(n0, bottom) as nz, greatest({LEVELS}[bottom + 2] + depth, {ROUGH}) as dz from n),
  f as (select *, case when bed then (q + depth) / dz else (q - {LEVELS}[n0 + 1]) / ((case when n0 < 4 then {LEVELS}[n0 + 2] else tide end) - {LEVELS}[n0 + 1]) end as zf from g)
  select *, case when bed then {LOG.format(zf='zf', dz='dz')} else zf end as zfv from f)"""


@query(f"select id, cast(nz as integer) as nz, {s6('zf')} as zf, {s6('zfv')} as zfv, {s6('q')} as z, cast(10 as bigint) as status from {FIXED_SQL}")
def fixedz_cell(spark, sf):
    """The layer of a fixed grid over a ragged bottom; nothing is told to lie on it."""
    out = kernel.evaluate(start(spark, sf), block(spark, kernel.FIXED_Z), T)
    return out.select("id", "nz", *[r6(F.col(n)).alias(n) for n in ("zf", "zfv", "z")], "status")


def sampled(cells: str, place: str, ragged: bool) -> str:
    low, high = (f"greatest(nz, {BOTTOM})", f"greatest(nz + 1, {BOTTOM})") if ragged else ("nz", "nz + 1")
    at = lambda k: FIELD.replace("k *", f"({k}) *")
    return f"select s.id, {s6(f'sum(b * share * ((1 - {place}) * {at(low)} + {place} * {at(high)}))')} as u from {cells} s join {NEAR} n on n.id = s.id, {STEPS} group by 1"


@query(sampled(SIGMA_SQL, "zfv", False))
def field_3d(spark, sf):
    """I4: a 3-D field in all layers, at times between steps."""
    return kernel.evaluate(start(spark, sf), block(spark, kernel.SIGMA), T).select("id", r6(F.col("u")).alias("u"))


@query(sampled(FIXED_SQL, "zf", True))
def field_3d_ragged(spark, sf):
    """Over a ragged bottom."""
    return kernel.evaluate(start(spark, sf), block(spark, kernel.FIXED_Z), T).select("id", r6(F.col("u")).alias("u"))


@query(f"select id, tri from {LOC} where least(b0, b1, b2) > 0.002")
def walk_search(spark, sf):
    """All walk from the first cell to where they are, but for those within the tolerance of an edge."""
    inside = located(spark, sf).where(F.least("b0", "b1", "b2") > 0.002).select("id")
    at = start(spark, sf).join(inside, "id").withColumn("tri", F.lit(0).cast("long"))
    return kernel.evaluate(at, block(spark, kernel.SIGMA), T).select("id", "tri")


@query(f"select id, tri from {LOC}")
def cell_search(spark, sf):
    """Found without a cell to walk from, as after a walk that failed."""
    return kernel.evaluate(start(spark, sf, tri=False), block(spark, kernel.SIGMA), T).select("id", "tri")


def draw_sql(seed: int, step: int, key: str, what: int) -> str:
    """What Rules.draw() says, in DuckDB."""
    m = 1 << 64
    const = (((seed * 1_000_003 + step) & 0xFFFFFFFF) + what * 0xD1B54A32D192ED03) % m
    g = f"[(cast({key} as uhugeint) * {0x9E3779B97F4A7C15} + {const}) % {m}]"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        g = f"list_transform({g}, lambda g: (xor(g, g >> {shift}) * {factor}) % {m})"
    return f"((cast(list_transform({g}, lambda g: xor(g, g >> 31) >> 11)[1] as double) + 0.5) / 9007199254740992.0)"


def drawn_normal_sql(seed: int, step: int, key: str, what: int) -> str:
    return f"(sqrt(-2 * ln({draw_sql(seed, step, key, 2 * what)})) * cos(2 * pi() * {draw_sql(seed, step, key, 2 * what + 1)}))"


#: Depth and tide at the end of a step of the fields.
END = f"(select id, x, y, z, sum(b * {DEPTH}) as depth, sum(b * {TIDE.replace('nt', '1')}) as tide from {NEAR} group by all)"
MOVED = f"(select *, greatest(least(z, 1e9), -1e9) + 60.0 * (0.01 - 0.03) as z1 from (select id, x, y, depth, tide, least(greatest(z, -1e9), 1e9) as z from {END}))"
RESTS = "(greatest(z1, -depth) + depth) / greatest(abs(tide + depth), 0.25) < 0.0003 / greatest(abs(tide + depth), 0.25)"


@query(f"select id, {s6(f'case when {RESTS} then -depth else least(greatest(z1, -depth), tide) end')} as z, cast(case when {RESTS} then 6 else 10 end as bigint) as status from {MOVED}")
def fall_step(spark, sf):
    """One step with an upward current and a terminal velocity, clipped to the water."""
    b = flat_block(spark)
    b.w = b.w + 0.01
    return kernel.step_block(start(spark, sf), b, 1, order=1, fall=-0.03).select("id", r6(F.col("z")).alias("z"), "status")


STD = "(sqrt(2 * 60.0 * 1e-6) / 60.0)"


@query(f"select id, {s6(f'x + 60.0 * {STD} * {drawn_normal_sql(9, 0, chr(105) + chr(100), kernel.WALK_X)}')} as x, {s6(f'y + 60.0 * {STD} * {drawn_normal_sql(9, 0, chr(105) + chr(100), kernel.WALK_Y)}')} as y from {LOC}")
def random_walk_step(spark, sf):
    """One step of a random walk."""
    return kernel.step_block(start(spark, sf), flat_block(spark), 1, order=1, spread=1e-6, seed=9).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


LIFTED = f"(0.0003 + sqrt(2 * 0.4 * 0.0003 * 60.0 / (1 - 2 / pi()) * 0.02) * abs({drawn_normal_sql(4, 1, 'id', kernel.LIFT)}))"


@query(f"""with d as (select id, depth, tide, {LIFTED} as up from {END}) select id, {s6('least(-depth + up, tide)')} as z, cast(10 as bigint) as status from d""")
def resuspension_step(spark, sf):
    """From the bottom, where the second step finds them, upwards."""
    import numpy as np

    b = flat_block(spark)
    b.friction = np.full(b.tide.shape, 0.02)
    on = start(spark, sf).withColumn("z", F.lit(-1e6))
    lifted = kernel.step_block(on, b, 1, order=1, critical=0.01, seed=4)
    again = lifted.withColumn("nt", F.lit(1).cast("long"))
    b.tide = b.tide[[1, 1]]
    return kernel.step_block(again, b, 1, base=1, order=1, critical=0.01, seed=4).select("id", r6(F.col("z")).alias("z"), "status")


@query(f"""with p as (select id, {draw_sql(6, 0, 'id', kernel.CULL)} <= 0.2 as a, {draw_sql(6, 0, 'id', kernel.CULL_RATE)} <= 1 - exp(-0.005 * 60) as b from {LOC})
  select id, cast(case when a or b then -5 else 10 end as bigint) as status from p""")
def cull_step(spark, sf):
    """Culled with a chance, and at a rate."""
    out = kernel.step_block(start(spark, sf).withColumn("z", F.lit(-1.0)), flat_block(spark), 1, order=1, cull=0.2, cull_rate=0.005, seed=6)
    return out.select("id", "status")


@query(f"""with p as (select id, {draw_sql(2, 0, 'id', kernel.SPLIT)} <= 0.3 as c from {LOC}) select id, cast(null as bigint) as parent, cast(0 as bigint) as born from p union all select -1, id, 1 from p where c""")
def split_step(spark, sf):
    """Children with their parents; their own numbers are hashes."""
    out = kernel.step_block(start(spark, sf).withColumn("z", F.lit(-1.0)), flat_block(spark), 1, order=1, split=0.3, seed=2)
    return out.select(F.when(F.col("parent").isNull(), F.col("id")).otherwise(-1).cast("long").alias("id"), "parent", "born")


@query(f"""with p as (select id, x > 4.0 and x <= 9.0 and y > 3.0 and y <= 8.0 and {draw_sql(3, 0, 'id', kernel.SETTLE)} < 0.6 as s from {LOC}) select id, cast(case when s then 0 else 10 end as bigint) as status, case when s then cast(1 as bigint) end as settled from p""")
def settle_step(spark, sf):
    """Some of those in a polygon settle."""
    out = kernel.step_block(start(spark, sf).withColumn("z", F.lit(-1.0)), flat_block(spark), 1, order=1, settle=[(4.0, 3.0), (9.0, 3.0), (9.0, 8.0), (4.0, 8.0)], settle_chance=0.6, settle_time=1e9, seed=3)
    return out.select("id", "status", "settled")


@query(f"select id, cast(case when tri % 3 = 0 then 3 else 10 end as bigint) as status, cast(floor(255.0 * case when tri % 3 = 0 then 1 else 0 end) as double) as dry from {LOC}")
def strand_step(spark, sf):
    """Dry cells strand what is in them."""
    import numpy as np

    b = flat_block(spark)
    b.dry = np.repeat((np.arange(len(b.tri)) % 3 == 0)[None].astype(float), 2, 0)
    out = kernel.step_block(start(spark, sf).withColumn("z", F.lit(-1.0)), b, 1, order=1, strand=True).select("id", "status")
    return out.join(kernel.evaluate(start(spark, sf), b, T).select("id", "dry"), "id")


@query(f"select id, {s6('tide')} as z from {END}")
def float_step(spark, sf):
    """Kept at the surface."""
    return kernel.step_block(start(spark, sf), flat_block(spark), 1, order=1, floats=True).select("id", r6(F.col("z")).alias("z"))


@query(f"""with p as (select id, x, y, x + 60.0 * 0.1 as x1 from {LOC}) select id, {s6('case when x1 <= 14 then x1 else x end')} as x, cast(10 as bigint) as status from p""")
def boundary_step(spark, sf):
    """What would leave by a closed edge goes back to where it was."""
    b = flat_block(spark)
    b.u = b.u + 0.1
    return kernel.step_block(start(spark, sf).withColumn("z", F.lit(-1.0)), b, 1, order=1, z0=1e-12).select("id", r6(F.col("x")).alias("x"), "status")


@query(f"""with p as (select id, x, y, x + 60.0 * 0.1 as x1 from {LOC}) select id, {s6('x1')} as x, cast(case when x1 <= 14 then 10 else -1 end as bigint) as status from p""")
def open_boundary_step(spark, sf):
    """What leaves by an open edge is outside."""
    b = flat_block(spark)
    b.u = b.u + 0.1
    node_x, edge = b.x, b.adjacency.copy()
    for m in range(3):
        ends = b.tri[:, [(m + 1) % 3, (m + 2) % 3]]
        right = (node_x[ends] == node_x.max()).all(1) & (edge[:, m] == enums.DOMAIN_EDGE)
        edge[right, m] = enums.OPEN_EDGE
    b.adjacency = edge
    return kernel.step_block(start(spark, sf).withColumn("z", F.lit(-1.0)), b, 1, order=1, use_open=True, z0=1e-12).select("id", r6(F.col("x")).alias("x"), "status")


@query(f"select id, nt, cast(case when nt = 4 then -5 else 10 end as bigint) as status from {LOC}, (select unnest([1, 2, 3, 4]) as nt)")
def age_kill_steps(spark, sf):
    """Over its age after the third step, a particle is told as dead in the fourth, and no more."""
    at = start(spark, sf).withColumn("z", F.lit(-1.0)).withColumn("max_age", F.lit(28.0))
    return kernel.step_block(at, flat_block(spark), 6, per_field=0.16, order=1).select("id", "nt", "status")
