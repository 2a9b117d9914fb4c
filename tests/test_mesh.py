"""Meshes with holes, mixed cells; fields and polygons against plain Python; properties of counts."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftspark import functions as fn
from driftspark.operators import fields, mesh, spatial, stats


def test_rings_of_a_mesh_with_an_island(spark):
    node, cells = mesh.lattice(spark, 6, 7)
    hole = cells.where("cell not in (14, 15)")
    tri = mesh.split_quads(hole)
    domain, islands = mesh.outline(tri, node)
    assert len(domain) == 22 and 0 in domain and len(islands) == 1
    assert len(islands[0]) == 6
    with pytest.raises(ValueError):
        mesh.outline(tri, node, most=3)


def test_land_filter(spark):
    node, cells = mesh.lattice(spark, 3, 3)
    kept = mesh.land_filter(cells, node.where("node in (0, 1, 3)").select("node"))
    assert sorted(r.cell for r in kept.collect()) == [1, 2, 3]


def test_mixed_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 4, 2, None), (2, 4, 5, 6, 2)], "cell long, n0 long, n1 long, n2 long, n3 long")
    got = sorted(map(tuple, mesh.split_quads(cells).collect()))
    assert got == [(0, 0, 0, 1, 2), (1, 1, 1, 4, 2), (2, 2, 4, 5, 6), (3, 0, 0, 2, 3), (4, 2, 4, 6, 2)]
    data = spark.createDataFrame([(0, 5.0), (1, 6.0), (2, 7.0)], "cell long, v double")
    assert {r.tri: r.v for r in mesh.cell_data(mesh.split_quads(cells), data).collect()} == {0: 5, 1: 6, 2: 7, 3: 5, 4: 7}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_numbered(spark, width):
    keys = random.Random(1).sample(range(5000), 300)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.n for r in mesh.numbered(df, "k", "n", width).collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}


def winding(px, py, ring):
    total = 0.0
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        t = math.atan2(d - py, c - px) - math.atan2(b - py, a - px)
        total += t - 2 * math.pi * round(t / (2 * math.pi))
    return abs(total) > 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_parity_is_the_winding_number(spark, seed):
    rnd = random.Random(seed)
    rings = []
    for _ in range(3):
        n, cx, cy = rnd.randint(3, 12), rnd.uniform(-5, 5), rnd.uniform(-5, 5)
        rings.append([(cx + rnd.uniform(1, 6) * math.cos(2 * math.pi * k / n), cy + rnd.uniform(1, 6) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    pts = [(i, rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {tuple(r) for r in spatial.inside(df, spatial.polygon_edges(spark, rings), "id", 2.5).collect()}
    assert got == {(i, k) for i, x, y in pts for k, ring in enumerate(rings) if winding(x, y, ring)}


def test_location_and_interpolation_are_exact_for_linear_fields(spark):
    node, cells = mesh.lattice(spark, 9, 9)
    tri = mesh.split_quads(cells).drop("cell")
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(0, 8), rnd.uniform(0, 8), rnd.uniform(0, 3)) for i in range(200)] + [(900, 4.0, 4.0, 1.0), (901, 9.5, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double, t double")
    for size in (0.7, 1.0, 3.0):
        at = spatial.locate(df, spatial.corners(tri, node), size)
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
        field = node.select("node", (2 * F.col("x") - F.col("y")).alias("a"), steps.alias("nt")).select("node", "nt", (F.col("a") + 3 * F.col("nt")).alias("val"))
        got = {r.id: r.val for r in spatial.interpolate(at, field, "id").collect()}
        assert 901 not in got and len(got) == 201
        assert all(got[i] == pytest.approx(2 * x - y + 3 * t) for i, x, y, t in pts if i != 901)


def test_counts_add_up(spark):
    rnd = random.Random(3)
    rows = [(i % 5, rnd.uniform(-1, 11), rnd.uniform(-1, 11)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    for n in (1, 5):
        counts = stats.gridded(df.repartition(n), ["g"], ("x", 0, 1, 10), ("y", 0, 2.5, 4))
        assert counts.agg(F.sum("n")).first()[0] == sum(0 <= x < 10 and 0 <= y < 10 for _, x, y in rows)


def test_profiles(spark):
    one = spark.createDataFrame([([-10.0, -6.0, -3.0, 0.0], [0.0, 1.0, 2.0, 4.0])], "z array<double>, v array<double>")
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(fields.z_fractions("z")) == pytest.approx([0, 0.4, 0.7, 1])
    assert get(fields.z_fractions("z", 20.0)) == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert get(fields.gradient("v", "z")) == pytest.approx([0.25, 1 / 3, 2 / 3, 2 / 3])
    assert get(fields.zero_at_bottom("v", F.lit(1))) == [0, 0, 2, 4] and get(fields.at_bottom("v", F.lit(2))) == 2
    assert get(fields.depth_mean("v", "z")) == pytest.approx((2 + 4.5 + 9) / 10)
    assert get(fields.regrid("v", fields.z_fractions("z"), F.array(F.lit(0.0), F.lit(0.2), F.lit(1.0)))) == pytest.approx([0, 0.5, 4])
    q = fn.quantize("v", 0.0, 4.0)
    assert all(abs(a - b) < 1e-4 for a, b in zip([0.0, 4.0], [one.select(F.expr("v[0]").alias("v")).select(fn.dequantize(q, 0.0, 4.0)).first()[0], one.select(F.expr("v[3]").alias("v")).select(fn.dequantize(q, 0.0, 4.0)).first()[0]]))


def test_across_180_and_geographic(spark):
    node = spark.createDataFrame([(0, 179.0, 0.0), (1, -179.0, 0.0)], "node long, x double, y double")
    assert sorted(r.x for r in mesh.across_180(node).collect()) == [179.0, 181.0]
    assert mesh.is_geographic(node).first()[0] is True
