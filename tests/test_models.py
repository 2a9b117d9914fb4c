"""Maps against published numbers, rewritten fields, nested grids, rings, results; the readers have queries with SQL."""

import math
import time
from datetime import datetime
from functools import partial

import pytest
from pyspark.sql import functions as F

from driftspark import sources
from driftspark.operators import kernel, mesh, nested, projections, spatial
from driftspark.plans import models, observed
from driftspark.sources import hindcast


def test_transverse_mercator(spark):
    """A quarter of the meridian of GRS80 is 10,001,965.729 m; on the middle meridian the map is its length times the scale."""
    plain = projections.TransverseMercator(0.0, 1.0, 0.0, 0.0)
    rows = spark.createDataFrame([(0.0, 90.0), (0.0, 45.0), (3.0, 0.0)], "lon double, lat double")
    e, n = projections.to_map("lon", "lat", plain)
    got = [(r.e, r.n) for r in rows.select(e.alias("e"), n.alias("n")).collect()]
    assert got[0][1] == pytest.approx(10_001_965.729, abs=0.01) and got[1][1] == pytest.approx(4_984_944.378, abs=0.01)
    assert got[2][1] == pytest.approx(0, abs=1e-6) and got[2][0] == pytest.approx(334_111.0, abs=200)
    e, n = projections.to_map("lon", "lat", projections.NZTM)
    origin = spark.createDataFrame([(173.0, 0.0)], "lon double, lat double").select(e.alias("e"), n.alias("n")).first()
    assert origin.e == pytest.approx(1_600_000, abs=1e-6) and origin.n == pytest.approx(10_000_000, abs=1e-6)
    assert projections.utm(60, True).lon0 == 177.0


def test_rewrite_and_back(spark, tmp_path):
    h = hindcast.schism(*models.schism_tables(spark))
    limits = {"u": (-1.0, 4.0), "tide": (-1.0, 1.0)}
    hindcast.rewrite(h.field, str(tmp_path / "f"), limits, 1, drop=("w",), last=0)
    packed = spark.read.parquet(str(tmp_path / "f"))
    assert dict(packed.dtypes)["u"] == "array<smallint>" and dict(packed.dtypes)["tide"] == "smallint" and "w" not in packed.columns
    back = {r.node: (r.u, r.tide) for r in hindcast.unpacked(packed, limits).collect()}
    for r in h.field.where("nt = 0").collect():
        assert back[r.node][0] == pytest.approx(r.u, abs=5 / 65534) and back[r.node][1] == pytest.approx(r.tide, abs=2 / 65534)


def test_a_model_runs(spark, tmp_path):
    """From a model's tables through the kernel."""
    h = hindcast.schism(*models.schism_tables(spark))
    b = kernel.field_block(h.node, h.tri, mesh.adjacency(h.tri), h.field, 0, 1, 3600.0, h.kind, h.axis)
    at = spark.createDataFrame([(1, 0, -1, 3.3, 4.4, -2.0, 10)], "id long, nt long, tri long, x double, y double, z double, status long")
    (r,) = kernel.evaluate(at, b, 0.5).collect()
    assert r.nz >= 0 and -7 <= r.z <= 0.1 and r.u > 0


def test_field_blocks_refuse_gaps(spark):
    h = hindcast.schism(*models.schism_tables(spark))
    with pytest.raises(ValueError, match="each node once"):
        kernel.field_block(h.node, h.tri, mesh.adjacency(h.tri), h.field.where("node <> 5 or nt <> 1"), 0, 1, 60.0, h.kind)


def test_routing_between_grids(spark):
    node, cells = mesh.lattice(spark, 5, 5)
    tri = mesh.split_quads(cells).drop("cell")
    fine, fine_cells = mesh.lattice(spark, 5, 5, 0.25)
    fine = fine.select("node", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"))
    grids = [spatial.corners(tri, node), spatial.corners(mesh.split_quads(fine_cells).drop("cell"), fine)]
    at = spark.createDataFrame([(1, 1.6, 1.6, 0), (2, 3.3, 3.4, 1), (3, 1.5, 1.2, 1), (4, 9.0, 9.0, 1)], "id long, x double, y double, grid int")
    got = {r.id: (r.grid, r.moved_back) for r in nested.route(at, grids, [1.0, 0.25]).collect()}
    assert got == {1: (1, False), 2: (0, False), 3: (1, False), 4: (1, True)}


def test_equal_points_stay_apart(spark):
    node, cells = mesh.lattice(spark, 4, 4)
    triangles = spatial.corners(mesh.split_quads(cells).drop("cell"), node)
    rows = spark.createDataFrame([(1.2, 1.7), (1.2, 1.7), (2.0, 2.0), (2.0, 2.0), (2.0, 2.0), (9.0, 9.0)], "x double, y double")
    got = sorted((r.x, r.y) for r in spatial.locate(rows, triangles, 1.0).collect())
    assert got == [(1.2, 1.7)] * 2 + [(2.0, 2.0)] * 3


def test_rings_with_an_island(spark):
    node, cells = mesh.lattice(spark, 9, 9)
    hole = cells.where("not (n0 in (30, 31, 39, 40))")
    tri = mesh.split_quads(mesh.numbered(hole.withColumnRenamed("cell", "old"), "old", "cell").select("cell", "n0", "n1", "n2", "n3")).drop("cell")
    got = {r.node: r.is_domain for r in mesh.rings_by_kind(tri, node).collect()}
    ring, islands = mesh.outline(tri, node)
    assert {n for n, d in got.items() if d} == set(ring) and {n for n, d in got.items() if not d} == {n for r in islands for n in r} and len(islands) == 1


def test_many_edges_are_joined(spark, monkeypatch):
    rows = sources.observations(spark, "/root/testdata/sf0.001").select("event_id", "x", "y")
    edges = spatial.polygon_edges(spark, [[(20, 5), (180, 10), (200, 60), (90, 80), (30, 50)], [(150, 30), (330, 30), (330, 90)]])
    few = sorted(map(tuple, spatial.polygon_of(rows, edges, "event_id", 20.0).collect()))
    monkeypatch.setattr(spatial, "EDGES_INLINE", 0)
    assert sorted(map(tuple, spatial.polygon_of(rows, edges, "event_id", 20.0).collect())) == few and {r[3] for r in few} == {-1, 0, 1}


def test_results_come_back(spark, tmp_path):
    rows = sources.observations(spark, "/root/testdata/sf0.001")
    rows.write.parquet(str(tmp_path / "results/counts"))
    assert sources.read_result(spark, str(tmp_path), "results/counts").count() == rows.count()
    lists = spark.createDataFrame([(1, [3, 1]), (2, [5])], "id long, v array<int>")
    assert sorted(map(tuple, sources.unpack_ragged(sources.pack_ragged(lists, "id", "v"), "id", "v").collect())) == [(1, [3, 1]), (2, [5])]


def test_polygons_hold_what_is_just_below_their_right_edge(spark, tmp_path):
    """The left edges and the last numbers before the right ones, whatever y is."""
    x = [math.nextafter(60.0, 0.0), 20.0, 160.0, math.nextafter(20.0, 0.0), 259.9999999, 200.0]
    props = ['{"k": 1}', None, '{"k": 1}', '{"k": 1}', '{"k": 2000}', '{"k": -3}']
    rows = [(i, datetime(2024, 1, 1), 3 * i, "click", v, p) for i, (v, p) in enumerate(zip(x, props))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = models.polygon_connectivity(spark, str(tmp_path)).collect()
    assert sorted((r.poly, r.n, r.n_alive) for r in got) == [(0, 2, 6), (2, 2, 6)]


STATES = [(1, 5, 2.0, 10), (1, 7, None, None), (1, 11, 4.0, 3), (3, 8, 1.0, 6)]


def test_rectangular_places(spark):
    """Absent ones before, between and after, a step without any, blocks of two."""
    state = spark.createDataFrame(STATES, "nt long, id long, x double, status long")
    got = {(r.nt, r.first): (r.x, r.status) for r in sources.rectangular(state, ["x", "status"], {"status": -10}, 3).collect()}
    assert got == {
        (1, 0): ([2.0, None, None], [10, -10, -10]), (1, 3): ([4.0], [3]), (2, 0): ([None] * 3, [-10] * 3), (2, 3): ([None], [-10]),
        (3, 0): ([None, None, 1.0], [-10, -10, 6]), (3, 3): ([None], [-10]),
    }
    with pytest.raises(Exception, match="two states"):
        sources.rectangular(state.union(state), ["x"]).collect()


def test_rectangular_does_not_search_for_places(spark):
    """A wide block takes about as long a place as a narrow one."""
    state = spark.range(40_000).select(F.lit(0).cast("long").alias("nt"), "id", F.col("id").cast("double").alias("x"))
    spent = {}
    for size in (1_000, 1_000, 40_000):
        since = time.monotonic()
        assert sum(r.n for r in sources.rectangular(state, ["x"], None, size).select(F.expr("size(filter(x, v -> v is not null))").alias("n")).collect()) == 40_000
        spent[size] = time.monotonic() - since
    assert spent[40_000] < 2 * spent[1_000] + 1


def test_tracks_of_many_blocks_are_one_row_a_step(spark, monkeypatch):
    whole = sorted(map(tuple, observed.tracks_pivot(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(sources, "rectangular", partial(sources.rectangular, id_block=7))
    assert sorted(map(tuple, observed.tracks_pivot(spark, "/root/testdata/sf0.001").collect())) == [pytest.approx(r, abs=1e-5) for r in whole]
