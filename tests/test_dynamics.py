"""The kernel against exact solutions, closed edges, the joins; random parts by their statistics."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftspark import enums
from driftspark.operators import dynamics, kernel, mesh, release, spatial


def block(n=21, u=lambda x, y, t: -y, v=lambda x, y, t: x, steps=3, dt=1.0, open_right=False):
    """A lattice from -1 to 1 in both directions."""
    x, y = np.meshgrid(np.linspace(-1, 1, n), np.linspace(-1, 1, n))
    x, y = x.ravel(), y.ravel()
    q = np.array([r * n + c for r in range(n - 1) for c in range(n - 1)])
    tri = np.concatenate([np.stack([q, q + 1, q + n + 1], 1), np.stack([q, q + n + 1, q + n], 1)])
    faces, adj = {}, np.full(tri.shape, -1)
    for k, t in enumerate(tri.tolist()):
        for m in range(3):
            e = tuple(sorted((t[(m + 1) % 3], t[(m + 2) % 3])))
            if e in faces:
                j, i = faces[e]
                adj[k, m], adj[j, i] = j, k
            faces[e] = (k, m)
    if open_right:
        for (a, b), (k, m) in faces.items():
            if adj[k, m] == -1 and x[a] == x[b] == 1:
                adj[k, m] = enums.OPEN_EDGE
    f = np.array([[g(x, y, t) * np.ones_like(x) for t in range(steps)] for g in (u, v)])
    return dynamics.Block(x, y, tri, adj, f[0], f[1], 0, dt)


def start(b, x, y):
    x, y = np.array(x, float), np.array(y, float)
    cell = np.array([next(k for k in range(len(b.tri)) if b.barycentric(np.array([k]), np.array([p]), np.array([q])).min() > -1e-9) for p, q in zip(x, y)])
    return cell, x, y, np.full(len(x), enums.MOVING)


def particles(cell, x, y, status, **more):
    n = len(x)
    given = {"id": np.arange(n), "nt": np.zeros(n, np.int64), "tri": np.array(cell), "x": np.array(x, float), "y": np.array(y, float), "status": np.array(status)} | more
    return {name: np.asarray(given[name]).astype(kind) if name in given else np.full(n, kernel.EMPTY.get(name, 0), kind) for name, kind in kernel.COLUMNS}


def go(b, cell, x, y, status, steps, per_field, **rules):
    """cell, x, y, status after so many steps."""
    for now, _ in b.advance(particles(cell, x, y, status), steps, per_field, kernel.Rules(**rules)):
        pass
    return now["tri"], now["x"], now["y"], now["status"]


#: How much longer the radius gets in a step of the angle 0.05: the length of the step's series for exp(i * 0.05).
GROWN = {1: abs(1 + 0.05j), 2: abs(1 + 0.05j + 0.05j**2 / 2), 4: abs(1 + 0.05j + 0.05j**2 / 2 + 0.05j**3 / 6 + 0.05j**4 / 24)}


@pytest.mark.parametrize("order", GROWN)
def test_rotation_changes_the_radius_as_the_order_says(order):
    b = block(steps=9)
    cell, x, y, s = go(b, *start(b, [0.5, 0.1], [0.0, 0.3]), 80, 0.05, order=order)
    assert np.hypot(x, y) / np.hypot([0.5, 0.1], [0.0, 0.3]) == pytest.approx(GROWN[order] ** 80, abs=1e-9)
    assert abs(GROWN[4] ** 80 - 1) < 1e-7


def test_fourth_order():
    b = block(steps=9)
    errors = []
    for n in (4, 8):
        _, x, y, _ = go(b, *start(b, [0.5], [0.0]), n, 2.0 / n)
        errors.append(math.hypot(x[0] - 0.5 * math.cos(2), y[0] - 0.5 * math.sin(2)))
    assert 10 < errors[0] / errors[1] < 40


def test_there_and_back():
    b = block(steps=5, u=lambda x, y, t: -y * (1 + t / 4), v=lambda x, y, t: x * (1 + t / 4))
    cell, x, y, s = go(b, *start(b, [0.4], [0.2]), 40, 0.1)
    _, x, y, _ = go(b, cell, x, y, s, 40, -0.1)
    assert abs(x[0] - 0.4) < 1e-5 and abs(y[0] - 0.2) < 1e-5


def test_closed_and_open_edges():
    for open_right in (False, True):
        b = block(steps=9, u=lambda x, y, t: 0.3, v=lambda x, y, t: 0.0, open_right=open_right)
        _, x, y, s = go(b, *start(b, [0.5], [0.1]), 6, 1.0, use_open=True)
        if open_right:
            assert s[0] == enums.OUTSIDE_OPEN and x[0] > 1
        else:
            assert s[0] == enums.MOVING and 0.5 < x[0] <= 1


def test_dry_cells_block():
    b = block(steps=9, u=lambda x, y, t: 0.3, v=lambda x, y, t: 0.0)
    b.dry = np.where(b.x[b.tri].mean(1) > 0.6, 1, 0)[None].repeat(9, 0)
    _, x, _, s = go(b, *start(b, [0.1], [0.1]), 8, 1.0)
    assert x[0] <= 0.65 and s[0] == enums.MOVING


def test_random_walk_spreads_as_it_should():
    b = block(steps=3, u=lambda x, y, t: 0.0, v=lambda x, y, t: 0.0)
    n = 4000
    cell, x, y, s = (np.repeat(v, n) for v in start(b, [0.0], [0.0]))
    _, x, y, _ = go(b, cell, x, y, s, 10, 0.1, spread=0.005, seed=3)
    assert abs(np.var(x) / (2 * 0.005 * 1.0) - 1) < 0.1 and abs(np.mean(y)) < 0.01


def test_kernel_and_joins_agree(spark):
    node, cells = mesh.lattice(spark, 8, 8)
    tri = mesh.split_quads(cells).drop("cell")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    field = node.select("node", (F.col("y") * 0.01).alias("u"), (0.02 - F.col("x") * 0.003).alias("v"), steps.alias("nt"))
    pts = spark.range(40).select("id", (1.5 + F.col("id") % 7 * 0.7).alias("x"), (1.2 + F.floor(F.col("id") / 7) * 0.8).alias("y"))
    at = spatial.locate(pts, spatial.corners(tri, node), 1.0).select("id", F.lit(0).cast("long").alias("nt"), "tri", "x", "y", F.lit(10).cast("long").alias("status"))
    b = dynamics.field_block(node, tri, mesh.adjacency(tri), field, 0, 3, 10.0)
    for order in (1, 2, 4):
        a = {r.id: (r.x, r.y) for r in dynamics.step_block(at, b, 1, order=order).collect()}
        j = {r.id: (r.x, r.y) for r in dynamics.step_by_joins(at, spatial.corners(tri, node), field, 10.0, 1.0, order).collect()}
        assert a.keys() == j.keys() and all(a[k] == pytest.approx(j[k], abs=1e-9) for k in a)


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(1000)
    u, _ = dynamics.random_walk(0.1, 60.0, 5, "id")
    sums = {rows.repartition(n).select(u.alias("u")).agg(F.sum(F.col("u").cast("decimal(30,12)"))).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1
    drawn = np.array([r.u for r in rows.select((u / math.sqrt(2 * 60 * 0.1) * 60).alias("u")).collect()])
    assert abs(drawn.mean()) < 0.12 and abs(drawn.std() - 1) < 0.1


#: Just beyond the right edge: below a node at the height of a cell that has no edge there, of one that has, and within.
NEAR_EDGE = [(0.4, 0.1000001), (0.4, 0.05), (0.399999, 0.05)]


def just_over(open_right):
    b = block(u=lambda x, y, t: 0.6 + 1e-7, v=lambda x, y, t: 0.0, open_right=open_right)
    x, y = zip(*NEAR_EDGE)
    _, x, _, s = go(b, *start(b, x, y), 1, 1.0, order=1, use_open=True)
    return np.round(x, 7).tolist(), s.tolist()


def test_a_closed_edge_holds_what_is_just_over_it():
    assert just_over(False) == ([0.4, 0.4, 0.9999991], [enums.MOVING] * 3)


def test_an_open_edge_lets_out_what_is_just_over_it():
    assert just_over(True) == ([1.0000001, 1.0000001, 0.9999991], [enums.OUTSIDE_OPEN] * 2 + [enums.MOVING])


def test_split_and_cull(spark):
    state = spark.range(4000).select("id", F.lit(10).cast("long").alias("status"), F.lit(50.0).alias("age"))
    out = dynamics.split(state, 0.25, 1, [10], 7)
    child = out.where("parent is not null").collect()
    assert out.select("id").distinct().count() == out.count() and 850 < len(child) < 1150 and {c.age for c in child} == {0.0}
    dead = state.select(dynamics.culled(0.25, 2, [10], 7).alias("s")).where("s = -5").count()
    assert 850 < dead < 1150
    assert dynamics.cull_rate(1e-6, 10) == pytest.approx(1e-5, rel=1e-12) and dynamics.cull_rate(0.1, 10) == pytest.approx(1 - math.exp(-1))


def test_resuspension_lifts_from_the_bottom_only(spark):
    rows = spark.createDataFrame([(1, -10.0, 3 + 3, 0.02), (2, -10.0, 6, 0.001), (3, -4.0, 10, 0.5)], "id long, z double, status long, f double")
    z, s = dynamics.resuspended("z", F.lit(10.0), "f", 0.01, 60.0, 1, "id")
    got = {r.id: (r.z2, r.s2) for r in rows.select("id", z.alias("z2"), s.alias("s2")).collect()}
    assert got[1][0] > -10 and got[1][1] == 10 and got[2] == (-10.0, 6) and got[3] == (-4.0, 10)


@settings(max_examples=30, deadline=None)
@given(st.floats(-0.99, 0.99), st.floats(-0.99, 0.99), st.floats(-0.99, 0.99), st.floats(-0.99, 0.99))
def test_walks_end_in_the_cell_that_holds_the_point(a, b, x, y):
    m = block(9)
    cell = start(m, [a], [b])[0]
    found, bc, status = m.walk(cell, np.array([x]), np.array([y]), 0)
    assert status[0] == enums.CELL_OK and bc.min() > -kernel.TOLERANCE and abs(bc.sum() - 1) < 1e-9
    assert (bc[:, 0] * m.x[m.tri[found[0]]]).sum() == pytest.approx(x, abs=1e-9)


def test_polygon_release(spark):
    ring = [(0, 0), (10, 0), (5, 8)]
    got = release.polygon_points(spark, ring, 300, 1).collect()
    assert sorted(r.pt for r in got) == list(range(300))
    assert all(r.y <= 1.6 * r.x + 1e-9 and r.y <= 1.6 * (10 - r.x) + 1e-9 and r.y >= 0 for r in got)
    assert abs(np.mean([r.x for r in got]) - 5) < 0.4


def test_radius_release(spark):
    pts = spark.range(2000).select(F.col("id").alias("pt"), F.lit(0).alias("copy"), F.lit(0).alias("nt"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    for even, mean in ((False, 0.5), (True, 2 / 3)):
        r = np.array([math.hypot(q.x - 3, q.y - 4) for q in release.radius_points(pts, 1.0, 3, even).collect()])
        assert r.max() <= 1 + 1e-9 and abs(r.mean() - mean) < 0.03


def test_downstream(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0), (1.0, 1.0, 0.0, 0.0)], "x double, y double, u double, v double")
    assert [(round(r.x, 9), round(r.y, 9)) for r in release.downstream(df, 10.0).collect()] == [(6.0, 8.0), (1.0, 1.0)]
