"""Queries over meshes and fields: a lattice of 12 x 15 nodes, split in triangles, with points of the embeddings on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark import functions as fn
from driftspark.operators import dynamics, fields, mesh, release, spatial, stats
from driftspark.plans.registry import normal_sql, query, quoted, r6, random_sql, s6
from driftspark.sources import points

ROWS, COLS = 12, 15
NODE = f"(select i as node, cast(i % {COLS} as double) as x, cast(i // {COLS} as double) as y from range({ROWS * COLS}) t(i))"
CELL = f"(select i as cell, (i // {COLS - 1}) * {COLS} + i % {COLS - 1} as n0, (i // {COLS - 1}) * {COLS} + i % {COLS - 1} + 1 as n1, (i // {COLS - 1}) * {COLS} + i % {COLS - 1} + {COLS + 1} as n2, (i // {COLS - 1}) * {COLS} + i % {COLS - 1} + {COLS} as n3 from range({(ROWS - 1) * (COLS - 1)}) t(i))"
CELLS = (ROWS - 1) * (COLS - 1)
TRI = f"(select cell as tri, cell, n0, n1, n2 from {CELL} union all select {CELLS} + cell, cell, n0, n2, n3 from {CELL})"
FACE = f"(select tri, 0 as face, least(n1, n2) as a, greatest(n1, n2) as b from {TRI} union all select tri, 1, least(n2, n0), greatest(n2, n0) from {TRI} union all select tri, 2, least(n0, n1), greatest(n0, n1) from {TRI})"
ADJ = f"""(select f.tri, max(case when f.face = 0 then coalesce(g.tri, -1) end) as adj0, max(case when f.face = 1 then coalesce(g.tri, -1) end) as adj1,
  max(case when f.face = 2 then coalesce(g.tri, -1) end) as adj2 from {FACE} f left join {FACE} g on f.a = g.a and f.b = g.b and f.tri <> g.tri group by f.tri)"""
CORNER = f"""(select tri, n0, n1, n2, a.x as x0, a.y as y0, b.x as x1, b.y as y1, c.x as x2, c.y as y2, (a.x-c.x)*(b.y-c.y)-(b.x-c.x)*(a.y-c.y) as det
  from {TRI} join {NODE} a on a.node = n0 join {NODE} b on b.node = n1 join {NODE} c on c.node = n2)"""
PTS = """(select vec_id as id, 7 + 9 * cast(embedding[1] as double) as x, 5.5 + 8 * cast(embedding[2] as double) as y, 1.5 + cast(embedding[3] as double) as t from embeddings)"""
LOC = f"""(select p.id, p.x, p.y, p.t, tri, n0, n1, n2, ((y1-y2)*(p.x-x2)+(x2-x1)*(p.y-y2))/det as b0, ((y2-y0)*(p.x-x2)+(x0-x2)*(p.y-y2))/det as b1,
  1 - ((y1-y2)*(p.x-x2)+(x2-x1)*(p.y-y2))/det - ((y2-y0)*(p.x-x2)+(x0-x2)*(p.y-y2))/det as b2 from {PTS} p, {CORNER}
  where least(((y1-y2)*(p.x-x2)+(x2-x1)*(p.y-y2))/det, ((y2-y0)*(p.x-x2)+(x0-x2)*(p.y-y2))/det, 1 - ((y1-y2)*(p.x-x2)+(x2-x1)*(p.y-y2))/det - ((y2-y0)*(p.x-x2)+(x0-x2)*(p.y-y2))/det) > -1e-9
  qualify row_number() over (partition by p.id order by tri) = 1)"""
PROFILE = "(select p_partkey as node, [-10.0 - p_size / 10.0, -6.0, -3.0, -1.0, p_size / 50.0] as z, [0.0, 0.1, 0.3, 0.5, p_retailprice / 1000.0] as val, p_size as s from part)"


def built(spark):
    node, cells = mesh.lattice(spark, ROWS, COLS)
    return node, cells, mesh.split_quads(cells)


def pts(spark, sf):
    p = points(spark, sf)
    return p.select("id", (7 + 9 * F.col("x")).alias("x"), (5.5 + 8 * F.col("y")).alias("y"), (1.5 + F.col("z")).alias("t"))


def located(spark, sf):
    node, _, tri = built(spark)
    return spatial.locate(pts(spark, sf), spatial.corners(tri.drop("cell"), node), 1.0)


def profiles(spark, sf):
    from driftspark.sources import table

    z = F.array(-10.0 - F.col("p_size") / 10.0, F.lit(-6.0), F.lit(-3.0), F.lit(-1.0), F.col("p_size") / 50.0)
    val = F.array(F.lit(0.0), F.lit(0.1), F.lit(0.3), F.lit(0.5), F.col("p_retailprice") / 1000.0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), z.alias("z"), val.alias("val"), F.col("p_size").alias("s"))


def levels(df, *columns):
    """A row for each level of arrays, rounded."""
    return df.select("node", F.posexplode(F.arrays_zip(*columns)).alias("k", "v")).select("node", F.col("k").cast("long").alias("k"), *[r6(F.col(f"v.{n}")).alias(n) for n in columns])


def levels_sql(expression: str, source: str = PROFILE) -> str:
    return f"select node, cast(k as bigint) as k, {s6('v')} as v from (select node, unnest({expression}) as v, unnest(range(len({expression}))) as k from {source})"


@query(f"select tri, cell, n0, n1, n2 from {TRI}")
def quad_split(spark, sf):
    return built(spark)[2]


@query(f"select * from {ADJ}")
def adjacency(spark, sf):
    return mesh.adjacency(built(spark)[2])


@query(f"select tri from {ADJ} where least(adj0, adj1, adj2) < 0")
def boundary_tri(spark, sf):
    return mesh.boundary_triangles(mesh.adjacency(built(spark)[2]))


@query(f"select node, count(*) as n, min(tri) as first_tri, max(tri) as last_tri from (select tri, unnest([n0, n1, n2]) as node from {TRI}) group by 1")
def node_tri_map(spark, sf):
    out = mesh.node_triangles(built(spark)[2])
    return out.select("node", F.size("tris").cast("long").alias("n"), F.col("tris")[0].alias("first_tri"), F.element_at("tris", -1).alias("last_tri"))


@query(f"select tri, {s6('abs(det) / 2')} as area from {CORNER}")
def tri_area(spark, sf):
    node, _, tri = built(spark)
    return mesh.area(spatial.corners(tri, node)).select("tri", r6(F.col("area")).alias("area"))


OPEN = f"(select node from {NODE} where y = 0)"
EDGE = f"(select a, b from {FACE} group by 1, 2 having count(*) = 1)"


@query(f"""select n.node, case when o.node is not null then 3 when d.node is not null then 2 else 0 end as node_type from {NODE} n left join {OPEN} o on n.node = o.node
  left join (select distinct unnest([a, b]) as node from {EDGE}) d on n.node = d.node""")
def node_type(spark, sf):
    node, _, tri = built(spark)
    found = mesh.rings_by_kind(tri, node)
    return mesh.node_types(node, tri, found.where("is_domain"), found.where("not is_domain"), node.where("y = 0"))


@query(f"with r as (select distinct unnest([a, b]) as node from {EDGE}) select node, cast((select min(node) from r) as bigint) as ring, true as is_domain from r")
def boundary_rings(spark, sf):
    """The boundary's nodes by ring, without a driver."""
    node, _, tri = built(spark)
    return mesh.rings_by_kind(tri, node)


@query(f"""with f as (select f.tri, f.face, case when g.tri is not null then g.tri when f.a in {OPEN} and f.b in {OPEN} then -2 else -1 end as adj
  from {FACE} f left join {FACE} g on f.a = g.a and f.b = g.b and f.tri <> g.tri)
  select tri, max(adj) filter (face = 0) as adj0, max(adj) filter (face = 1) as adj1, max(adj) filter (face = 2) as adj2 from f group by tri""")
def open_boundary(spark, sf):
    node, _, tri = built(spark)
    types = node.select("node", F.when(F.col("y") == 0, 3).otherwise(0).alias("node_type"))
    return mesh.open_faces(tri.drop("cell"), mesh.adjacency(tri), types)


@query(f"select id, {s6('b0')} as b0, {s6('b1')} as b1, {s6('b2')} as b2 from {LOC}")
def barycentric(spark, sf):
    node, _, tri = built(spark)
    at = located(spark, sf).select("id", "x", "y", "tri")
    return at.join(mesh.transform(spatial.corners(tri.drop("cell"), node)), "tri").select("id", *[r6(b).alias(f"b{i}") for i, b in enumerate(mesh.barycentric(F.col("x"), F.col("y")))])


@query(f"select id, tri from {LOC}")
def locate_triangle(spark, sf):
    return located(spark, sf).select("id", "tri")


VAL = "(node % 7) * 1.5 + nt * 0.25 * (node % 3)"


@query(f"""with f as (select node, nt, {VAL} as val from range({ROWS * COLS}) a(node), range(5) b(nt)), w as (select id, cast(floor(t) as bigint) as nt, t - floor(t) as s, unnest([n0, n1, n2]) as node, unnest([b0, b1, b2]) as b from {LOC})
  select id, {s6('sum(b * ((1 - s) * f0.val + s * f1.val))')} as val from w join f f0 on f0.node = w.node and f0.nt = w.nt join f f1 on f1.node = w.node and f1.nt = w.nt + 1 group by 1""")
def interp_2d(spark, sf):
    field = spark.range(ROWS * COLS).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("nt"))
    return spatial.interpolate(located(spark, sf), field.withColumn("val", F.expr(VAL).cast("double")), "id").select("id", r6(F.col("val")).alias("val"))


@query(f"select id, cast(floor(t / 0.5) as bigint) as nt, {s6('1 - (t / 0.5 - floor(t / 0.5))')} as w0, {s6('t / 0.5 - floor(t / 0.5)')} as w1 from {PTS}")
def time_weights(spark, sf):
    s = F.col("t") / 0.5 - F.floor(F.col("t") / 0.5)
    return pts(spark, sf).select("id", F.floor(F.col("t") / 0.5).cast("long").alias("nt"), r6(1 - s).alias("w0"), r6(s).alias("w1"))


SIGMA = "[0.0, 0.05, 0.2, 0.5, 0.8, 1.0]"
ZF = "least(abs(x) / 20.0, 0.9999)"


@query(f"select id, cast(least(greatest(len(list_filter({SIGMA}, lambda s: s <= {ZF})) - 1, 0), 4) as bigint) as nz from {PTS}")
def sigma_lookup(spark, sf):
    sigma = F.array(*[F.lit(v) for v in (0.0, 0.05, 0.2, 0.5, 0.8, 1.0)])
    return pts(spark, sf).select("id", fn.lookup(sigma, F.least(F.abs("x") / 20.0, F.lit(0.9999))).cast("long").alias("nz"))


FIXED = "[-20.0, -10.0, -5.0, -2.0, 0.0]"


@query(f"select id, cast(least(greatest(len(list_filter({FIXED}, lambda s: s <= -y)) - 1, 0), 3) as bigint) as nz from {PTS}")
def fixedz_lookup(spark, sf):
    levels_ = F.array(*[F.lit(v) for v in (-20.0, -10.0, -5.0, -2.0, 0.0)])
    return pts(spark, sf).select("id", fn.lookup(levels_, -F.col("y")).cast("long").alias("nz"))


@query(f"select id, {s6('case when abs(y) > 0.0003 then ln((t / 4 * abs(y) + 0.0003) / 0.0003) / ln((abs(y) + 0.0003) / 0.0003) else 0.0 end')} as w from {PTS} where t >= 0")
def log_layer(spark, sf):
    return pts(spark, sf).where("t >= 0").select("id", r6(fn.log_layer(F.col("t") / 4, F.abs("y"))).alias("w"))


@query(f"""with p as (select *, -8 + 7 * (s / 50.0) as q from {PROFILE}), k as (select *, least(greatest(len(list_filter(z, lambda v: v <= q)) - 1, 0), 3) as k from p)
  select node, {s6('val[k+1] + (q - z[k+1]) * (val[k+2] - val[k+1]) / (z[k+2] - z[k+1])')} as v from k""")
def interp_3d(spark, sf):
    q = -8 + 7 * (F.col("s") / 50.0)
    p = profiles(spark, sf).withColumn("q", q).withColumn("k", fn.lookup("z", q))
    at = lambda a, i: F.get(a, F.col("k") + i)
    return p.select("node", r6(fn.linear("q", at("z", 0), at("z", 1), at("val", 0), at("val", 1))).alias("v"))


@query(f"select node, bool_or(is_dry) as dry from (select tri as node, (n0 % 5) * 0.1 + (n0 % 3) * 0.1 < 0.25 as is_dry from {TRI} union all select tri, (n1 % 5) * 0.1 + (n1 % 3) * 0.1 < 0.25 from {TRI} union all select tri, (n2 % 5) * 0.1 + (n2 % 3) * 0.1 < 0.25 from {TRI}) group by 1")
def dry_cell(spark, sf):
    node, _, tri = built(spark)
    water = node.select("node", ((F.col("node") % 5) * 0.1).alias("tide"), ((F.col("node") % 3) * 0.1).alias("water_depth"))
    return fields.dry_cells(tri, water).select(F.col("tri").alias("node"), F.col("is_dry").alias("dry"))


@query(f"select node, {s6('case when z[2] - z[1] > 0.0003 then 0.4 * sqrt(val[2] * val[2] + val[2] * val[2]) / ln((z[2] - z[1] + 0.0003) / 0.0003) else 0.0 end')} as v from {PROFILE}")
def friction_velocity(spark, sf):
    return profiles(spark, sf).select("node", r6(fields.bottom_friction("val", "val", "z")).alias("v"))


@query(levels_sql("list_transform(range(5), lambda i: case when z[least(i, 3) + 2] - z[least(i, 3) + 1] > 0.0003 then (val[least(i, 3) + 2] - val[least(i, 3) + 1]) / (z[least(i, 3) + 2] - z[least(i, 3) + 1]) else 0.0 end)"))
def vertical_gradient(spark, sf):
    return levels(profiles(spark, sf).withColumn("v", fields.gradient("val", "z")), "v")


@query(levels_sql("list_transform(z, lambda v: (v - z[1]) / (z[5] - z[1]))"))
def z_fractions(spark, sf):
    return levels(profiles(spark, sf).withColumn("v", fields.z_fractions("z")), "v")


LAYER = """(select node, [(z[1]+z[2])/2, (z[2]+z[3])/2, (z[3]+z[4])/2, (z[4]+z[5])/2] as mid, z, val from """ + PROFILE + ")"
SEG = "least(greatest(len(list_filter(mid, lambda m: m <= q)) - 1, 0), 2)"


@query(levels_sql(f"list_transform(z, lambda q: val[{SEG}+1] + (q - mid[{SEG}+1]) * (val[{SEG}+2] - val[{SEG}+1]) / (mid[{SEG}+2] - mid[{SEG}+1]))", LAYER))
def layer_to_interface(spark, sf):
    mid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get("z", i) + F.get("z", i + 1)) / 2)
    p = profiles(spark, sf).withColumn("mid", mid)
    return levels(p.withColumn("v", fields.layers_to_interfaces(F.slice("val", 1, 4), "mid", "z")), "v")


@query(f"select node, {s6('((val[1]+val[2])/2*(z[2]-z[1]) + (val[2]+val[3])/2*(z[3]-z[2]) + (val[3]+val[4])/2*(z[4]-z[3]) + (val[4]+val[5])/2*(z[5]-z[4])) / (z[5]-z[1])')} as v from {PROFILE}")
def depth_average(spark, sf):
    return profiles(spark, sf).select("node", r6(fields.depth_mean("val", "z")).alias("v"))


@query(levels_sql("list_transform(range(5), lambda i: case when i <= s % 4 then 0.0 else val[i + 1] end)"))
def bottom_zero(spark, sf):
    return levels(profiles(spark, sf).withColumn("v", fields.zero_at_bottom("val", F.col("s") % 4)), "v")


GRID = "(select a.i as r, b.i as c, case when (a.i * 3 + b.i) % 11 = 0 then null else (a.i * 7 + b.i * 3) % 13 * 0.5 end as val from range(9) a(i), range(8) b(i))"


def grid(spark):
    cells = spark.range(72).select(F.floor(F.col("id") / 8).alias("r"), (F.col("id") % 8).alias("c"))
    val = F.when((F.col("r") * 3 + F.col("c")) % 11 == 0, None).otherwise((F.col("r") * 7 + F.col("c") * 3) % 13 * 0.5)
    return cells.withColumn("val", val)


@query(f"select a.r, a.c, (coalesce(a.val, 0) + coalesce(b.val, 0)) / 2.0 as val from {GRID} a join {GRID} b on b.r = a.r + 1 and b.c = a.c")
def u_to_psi(spark, sf):
    return fields.u_to_psi(grid(spark))


@query(f"select a.r, a.c, (coalesce(a.val, 0) + coalesce(b.val, 0)) / 2.0 as val from {GRID} a join {GRID} b on b.c = a.c + 1 and b.r = a.r")
def v_to_psi(spark, sf):
    return fields.u_to_psi(grid(spark), "c")


@query(f"""select a.r, a.c, {s6('avg(b.val)')} as val from {GRID} a join {GRID} b on b.r - a.r in (0, 1) and b.c - a.c in (0, 1) where a.r < 8 and a.c < 7 group by 1, 2""")
def rho_to_psi(spark, sf):
    return fields.rho_to_psi(grid(spark)).select("r", "c", r6(F.col("val")).alias("val"))


@query(f"""with c as (select tri, n0, n1, n2, (x0+x1+x2)/3 as cx, (y0+y1+y2)/3 as cy, case when tri % 9 = 0 then null else (tri % 17) * 0.3 end as val from {CORNER}),
  w as (select node, val, 1.0 / greatest(sqrt(power(n.x - cx, 2) + power(n.y - cy, 2)), 0.01) as w from (select *, unnest([n0, n1, n2]) as k from c) join {NODE} n on n.node = k)
  select node, {s6('sum(w * val) / sum(w) * count(*) / nullif(count(val), 0)')} as val from w group by 1""")
def cell_to_node_idw(spark, sf):
    node, _, tri = built(spark)
    value = tri.select("tri", F.when(F.col("tri") % 9 == 0, None).otherwise((F.col("tri") % 17) * 0.3).alias("val"))
    return fields.cells_to_nodes(tri, node, value).select("node", r6(F.col("val")).alias("val"))


END = f"(select i // 18 as r, i % 18 as c, i % 18 + 0.3 * sin((i // 18) / 3.0) as x, i // 18 + 0.2 * cos((i % 18) / 4.0) as y from range(324) t(i))"


@query(f"""with f as (select m.r, m.c, (e.x-w.x)/2.0 as fxx, (n.x-s.x)/2.0 as fxy, (e.y-w.y)/2.0 as fyx, (n.y-s.y)/2.0 as fyy from {END} m join {END} e on e.r=m.r and e.c=m.c+1 join {END} w on w.r=m.r and w.c=m.c-1
  join {END} n on n.r=m.r+1 and n.c=m.c join {END} s on s.r=m.r-1 and s.c=m.c), t as (select r, c, fxx*fxx+fyx*fyx as a, fxx*fxy+fyx*fyy as b, fxy*fxy+fyy*fyy as d from f)
  select r, c, {s6('ln(sqrt((a+d)/2.0+sqrt((a-d)*(a-d)/4.0+b*b))) / 10.0')} as ftle from t""")
def ftle_2d(spark, sf):
    r, k = F.floor(F.col("id") / 18), F.col("id") % 18
    end = spark.range(324).select(r.alias("r"), k.alias("c"), (k + 0.3 * F.sin(r / 3.0)).alias("x"), (r + 0.2 * F.cos(k / 4.0)).alias("y"))
    return stats.ftle(end, 10.0).select("r", "c", r6(F.col("ftle")).alias("ftle"))


@query(f"select id, {s6('x + -0.1 * y * 0.5')} as x, {s6('y + 0.1 * x * 0.5')} as y from {PTS}")
def euler_step(spark, sf):
    return pts(spark, sf).select("id", r6(dynamics.euler("x", -0.1 * F.col("y"), 0.5)).alias("x"), r6(dynamics.euler("y", 0.1 * F.col("x"), 0.5)).alias("y"))


@query(f"select id, {s6('x - 0.1 * (y + 0.1 * x * 0.25) * 0.5')} as x, {s6('y + 0.1 * (x - 0.1 * y * 0.25) * 0.5')} as y from {PTS}")
def rk2_step(spark, sf):
    x, y = dynamics.runge_kutta(2, F.col("x"), F.col("y"), lambda x, y: (-0.1 * y, 0.1 * x), 0.5)
    return pts(spark, sf).select("id", r6(x).alias("x"), r6(y).alias("y"))


@query(f"""with a as (select id, x, y, -0.1 * y as u1, 0.1 * x as v1 from {PTS}), b as (select *, -0.1 * (y + v1 * 0.25) as u2, 0.1 * (x + u1 * 0.25) as v2 from a),
  c as (select *, -0.1 * (y + v2 * 0.25) as u3, 0.1 * (x + u2 * 0.25) as v3 from b), d as (select *, -0.1 * (y + v3 * 0.5) as u4, 0.1 * (x + u3 * 0.5) as v4 from c)
  select id, {s6('x + (u1 + 2 * u2 + 2 * u3 + u4) * (0.5 / 6)')} as x, {s6('y + (v1 + 2 * v2 + 2 * v3 + v4) * (0.5 / 6)')} as y from d""")
def rk4_step(spark, sf):
    x, y = dynamics.runge_kutta(4, F.col("x"), F.col("y"), lambda x, y: (-0.1 * y, 0.1 * x), 0.5)
    return pts(spark, sf).select("id", r6(x).alias("x"), r6(y).alias("y"))


@query("select i * 4 as nt, cast(1000.0 + i * 4 * 900.0 as double) as time_sec from range(25) t(i)")
def schedule_interval(spark, sf):
    return release.interval_schedule(spark, 1000.0, 1000.0 + 99 * 900.0, 900.0, 3500.0)


@query(f"select id, cast(round_even((x * 100 - 50) / 30.0, 0) as bigint) as nt from {PTS}")
def schedule_times(spark, sf):
    return pts(spark, sf).select("id", release.nearest_step(F.col("x") * 100, 50.0, 30.0).alias("nt"))


PULSES = """(select n.i * 2 as nt, g.i as grp, p.i as pt, k.i as copy, cast(10.0 * p.i as double) as x, cast(5.0 * g.i as double) as y from range(6) n(i), range(2) g(i), range(3) p(i), range(4) k(i))"""


def released(spark):
    pt = spark.range(6).select((F.col("id") % 2).alias("grp"), F.floor(F.col("id") / 2).alias("pt"))
    pt = pt.select("grp", "pt", (10.0 * F.col("pt")).alias("x"), (5.0 * F.col("grp")).alias("y"))
    return release.pulses(pt, release.interval_steps(0.0, 3600.0 * 11, 3600.0, 7200.0), 4)


@query(f"select nt, grp, pt, cast(copy as integer) as copy, x, y from {PULSES}")
def point_release(spark, sf):
    return released(spark).select("nt", "grp", "pt", "copy", "x", "y")


@query(f"select row_number() over (order by nt, grp, pt, copy) - 1 as id, nt, grp, pt, cast(copy as integer) as copy, 10 as status from {PULSES}")
def id_assign(spark, sf):
    return release.assign_ids(released(spark), 2, 3, 4).select("id", "nt", "grp", "pt", "copy", "status")


@query(f"select i as pt, i // 4 as r, i % 4 as c, {s6('50.0 - 50.0 + (i % 4) * 100.0 / 3')} as x, {s6('20.0 - 10.0 + (i // 4) * 20.0 / 2')} as y from range(12) t(i)")
def grid_release(spark, sf):
    g = release.grid_points(spark, 3, 4, 100.0, 20.0, 50.0, 20.0)
    return g.select("pt", "r", "c", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"""select id, {s6('greatest(t - 0.5, -abs(y))')} as at_surface, {s6('least(-abs(y) + 0.5, t)')} as at_bottom,
  {s6('greatest(-abs(y), -6.0) + 0.25 * (least(t, 1.0) - greatest(-abs(y), -6.0))')} as between_ from {PTS}""")
def vertical_release(spark, sf):
    at = lambda s, b, lo, hi: r6(release.vertical("t", F.abs("y"), s, b, 0.5, lo, hi, F.lit(0.25)))
    return pts(spark, sf).select("id", at(True, False, None, None).alias("at_surface"), at(False, True, None, None).alias("at_bottom"), at(False, False, -6.0, 1.0).alias("between_"))


@query(f"select id, {s6('cos(radians(y)) / 111000.0 * 1e6')} as px, {s6('1 / 111000.0 * 1e6')} as py, {s6('1 / (111000.0 * cos(radians(y))) * 1e6')} as cx from {PTS}")
def degrees_per_metre(spark, sf):
    """Degrees a million metres span, with the cosine as the reference has it and as it should be."""
    px, py = fn.degrees_per_metre("y")
    return pts(spark, sf).select("id", r6(px * 1e6).alias("px"), r6(py * 1e6).alias("py"), r6(fn.degrees_per_metre("y", "corrected")[0] * 1e6).alias("cx"))


@query(f"select i // 8 as r, i % 8 as c, cast(1000 as double) as area, cast(2500 as double) as volume, {s6('50.0 * (111.0 / cos(radians(10 + (i // 8) * 20.0))) * 20.0 * 111.0')} as geo_km2 from range(32) t(i)")
def cell_area(spark, sf):
    """Areas and volumes of a statistic's cells, in metres and in degrees."""
    cells = spark.range(32).select(F.floor(F.col("id") / 8).alias("r"), (F.col("id") % 8).alias("c"))
    out = stats.cell_sizes(cells, ("x", 0, 50.0, 8), ("y", 0, 20.0, 5), ("z", -10, 2.5, 4))
    geo = stats.cell_sizes(cells, ("x", 0, 50.0, 8), ("y", 0, 20.0, 5), geographic=True).withColumn("geo_km2", F.col("area") / 1e6).drop("area")
    return out.join(geo, ["r", "c"]).select("r", "c", "area", "volume", r6(F.col("geo_km2")).alias("geo_km2"))


@query("select r, c, cast(case when c >= 5 then c * 40 - 360 + 360 else c * 40 end as double) as x from " + GRID)
def lon_across_180(spark, sf):
    g = grid(spark).withColumn("x", F.when(F.col("c") >= 5, F.col("c") * 40 - 360).otherwise(F.col("c") * 40).cast("double"))
    return mesh.across_180(g).select("r", "c", "x")


H = "(1e-3 * 60.0)"
GAIN, TURN = f"(1 - {H} * {H} / 2 + power({H}, 4) / 24)", f"({H} - power({H}, 3) / 6)"
RING = f"(select id, x - 7.0 as dx, y - 5.5 as dy from {PTS} where (x - 7.0) * (x - 7.0) + (y - 5.5) * (y - 5.5) < 25)"


@query(f"""with n as (select cast(i * 10 as bigint) as nt from range(1, 7) t(i)), g as (select sqrt({GAIN} * {GAIN} + {TURN} * {TURN}) as r, atan2({TURN}, {GAIN}) as a)
  select id, nt, floor((7.0 + power(r, nt) * (cos(nt * a) * dx - sin(nt * a) * dy)) * 1e6 + 0.5) / 1e6 as x, floor((5.5 + power(r, nt) * (sin(nt * a) * dx + cos(nt * a) * dy)) * 1e6 + 0.5) / 1e6 as y,
    cast(10 as bigint) as status from {RING}, n, g""")
def circle_tracks(spark, sf):
    """Particles carried around by a solid rotation on the lattice, by the kernel: every tenth of 60 steps.

    The steps of a linear field are powers of one matrix, which the SQL takes at once.
    """
    node, _, tri = built(spark)
    field = node.select("node", (-(F.col("y") - 5.5) * 1e-3).alias("u"), ((F.col("x") - 7.0) * 1e-3).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"))).alias("nt"))
    block = dynamics.field_block(node, tri.drop("cell"), mesh.adjacency(tri), field, 0, 60, 60.0)
    near = located(spark, sf).where((F.col("x") - 7.0) * (F.col("x") - 7.0) + (F.col("y") - 5.5) * (F.col("y") - 5.5) < 25)
    start = near.select("id", F.lit(0).cast("long").alias("nt"), "tri", "x", "y", F.lit(10).cast("long").alias("status"))
    return dynamics.step_block(start, block, 60, every=10).select("id", "nt", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "status")


@query(f"""with a as (select id, x, y from {LOC}), b as (select id, x + -0.001 * (y - 5.5) * 60 as x2, y + 0.001 * (x - 7.0) * 60 as y2, x, y from a)
  select id, {s6('case when x2 between 0 and 14 and y2 between 0 and 11 then x2 else x end')} as x, {s6('case when x2 between 0 and 14 and y2 between 0 and 11 then y2 else y end')} as y from b""")
def step_by_joins(spark, sf):
    node, _, tri = built(spark)
    field = node.select("node", (-(F.col("y") - 5.5) * 1e-3).alias("u"), ((F.col("x") - 7.0) * 1e-3).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("nt"))
    start = located(spark, sf).select("id", F.lit(0).cast("long").alias("nt"), "x", "y", F.lit(10).cast("long").alias("status"))
    out = dynamics.step_by_joins(start, spatial.corners(tri.drop("cell"), node), field, 60.0, 1.0, order=1)
    return out.select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


TRIES = f"(select i, 0 + 10 * {random_sql(42, '0', 'i', quoted('x'))} as x, 0 + 8 * {random_sql(42, '0', 'i', quoted('y'))} as y from range(2050) t(i))"


@query(f"""with e as (select * from (values (0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 5.0, 8.0), (5.0, 8.0, 0.0, 0.0)) e(x1, y1, x2, y2)),
  h as (select i, x, y, count(*) as n from {TRIES} join e on y > least(y1, y2) and y <= greatest(y1, y2) and x <= greatest(x1, x2) and (x1 = x2 or x <= x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0)) group by all)
  select row_number() over (order by i) - 1 as pt, {s6('x')} as x, {s6('y')} as y from h where n % 2 = 1 qualify row_number() over (order by i) <= 500""")
def polygon_release(spark, sf):
    p = release.polygon_points(spark, [(0, 0), (10, 0), (5, 8)], 500, 42)
    return p.select("pt", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


WALK = f"sqrt(2 * 60.0 * 0.1) / 60.0"


@query(f"""with p as (select id, x + {WALK} * {normal_sql(5, 'id', '0', quoted('u'))} * 60 as x, y + {WALK} * {normal_sql(5, 'id', '0', quoted('v'))} * 60 as y,
    cast(case when {random_sql(6, 'id', '0')} <= 0.1 then -5 else 10 end as bigint) as status, cast(100 as double) as age from {PTS})
  select id, {s6('x')} as x, {s6('y')} as y, status, age, cast(null as bigint) as parent from p
  union all select -1, {s6('x')}, {s6('y')}, status, cast(0 as double), id from p where status = 10 and {random_sql(8, 'id', '0')} <= 0.2""")
def dispersed(spark, sf):
    """A random walk step, a cull and a split, all by hashes of the ids."""
    u, v = dynamics.random_walk(0.1, 60.0, 5, "id", F.lit(0))
    p = pts(spark, sf).select("id", (F.col("x") + u * 60).alias("x"), (F.col("y") + v * 60).alias("y"), F.lit(10).cast("long").alias("status"), F.lit(100.0).alias("age"))
    p = p.withColumn("status", dynamics.culled(0.1, 6, [10], 0).cast("long"))
    out = dynamics.split(p, 0.2, 8, [10], 0)
    # a child's number is a hash; what it comes from says enough
    return out.select(F.when(F.col("parent").isNull(), F.col("id")).otherwise(-1).cast("long").alias("id"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "status", "age", "parent")
