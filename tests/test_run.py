"""Whole runs, restarts, parameters and users' parts; files and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from driftspark import params, sources, streaming
from driftspark.operators import kernel, mesh, stats
from driftspark.plans import run as runs


@pytest.fixture(scope="module")
def flow(spark):
    node, cells = mesh.lattice(spark, 11, 11)
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")))
    field = node.select("node", (-(F.col("y") - 5) * 1e-4).alias("u"), ((F.col("x") - 5) * 1e-4).alias("v"), steps.alias("nt"))
    return node.cache(), mesh.split_quads(cells).drop("cell").cache(), field.cache()


def made(spark, flow, folder, **more):
    how = {"time_step": 600.0, "use_dispersion": False, "steps_per_block": 7, "max_run_duration": 12000.0} | more
    return runs.Run(spark, *flow, str(folder)).settings(**how)


def test_circle(spark, flow, tmp_path):
    tracks = made(spark, flow, tmp_path).add("release_groups", "point", points=[(7, 5), (5, 8)], release_interval=6000.0, pulse_size=2).run()
    rows = tracks.collect()
    assert {r.nt for r in rows} == set(range(21)) and len({(r.id, r.nt) for r in rows}) == len(rows)
    assert len({r.id for r in rows}) == 12 and len(rows) == 4 * (21 + 11 + 1)
    begun = {}
    for r in sorted(rows, key=lambda r: r.nt):
        x0, y0, n0 = begun.setdefault(r.id, (r.x, r.y, r.nt))
        a = 1e-4 * 600 * (r.nt - n0)
        assert r.x - 5 == pytest.approx((x0 - 5) * math.cos(a) - (y0 - 5) * math.sin(a), abs=1e-5)
        assert r.age == 600 * (r.nt - n0) and r.time_sec == 600 * r.nt


def test_restart_gives_the_same(spark, flow, tmp_path):
    group = {"points": [(7, 5)], "pulse_size": 3, "release_interval": 1200.0, "max_age": 6000.0}
    whole = made(spark, flow, tmp_path / "a", use_dispersion=True, A_H=1e-6).add("release_groups", "radius", radius=0.3, **group).run()
    made(spark, flow, tmp_path / "b", use_dispersion=True, A_H=1e-6, max_run_duration=4200.0).add("release_groups", "radius", radius=0.3, **group)
    part = made(spark, flow, tmp_path / "b", use_dispersion=True, A_H=1e-6).add("release_groups", "radius", radius=0.3, **group)
    part.run()
    for b in (1, 2):  # as if lost after the first block
        for t in ("tracks", "state"):
            for f in (tmp_path / "b" / t / f"block={b}").iterdir():
                f.unlink()
            (tmp_path / "b" / t / f"block={b}").rmdir()
    again = part.run(restart=True)
    key = lambda r: (r.id, r.nt)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    # what is over its age is told as alive once, as the check comes after, and then as dead, once
    assert whole.where("status > -5").agg(F.max("age")).first()[0] == 6600.0 and key
    dead = whole.where("status = -5").groupBy("id").agg(F.count("*").alias("n"), F.max("age").alias("age")).collect()
    assert dead and {(r.n, r.age) for r in dead} == {(1, 7200.0)}


@pytest.mark.parametrize("order", [1, 4])
def test_fields_too_large_to_send_are_stepped_by_joins(spark, flow, tmp_path, monkeypatch, order):
    group = {"points": [(7, 5), (5, 7.5)], "release_interval": 600.0, "duration": 600.0, "max_age": 1200.0}
    how = {"max_run_duration": 2400.0, "steps_per_block": 3, "RK_order": order}
    sent = made(spark, flow, tmp_path / "a", **how).add("release_groups", "point", **group).run().select("id", "nt", "x", "y", "status").collect()
    monkeypatch.setattr(kernel, "BLOCK_MB", 0)
    joined = made(spark, flow, tmp_path / "b", **how).add("release_groups", "point", **group).run().select("id", "nt", "x", "y", "status").collect()
    key = lambda r: (r.id, r.nt, r.status)
    assert sorted(map(key, sent)) == sorted(map(key, joined)) and {r.status for r in sent} == {10, -5}
    where = {key(r): (r.x, r.y) for r in joined}
    assert all(where[key(r)] == pytest.approx((r.x, r.y), abs=1e-9) for r in sent)
    with pytest.raises(ValueError, match="too large"):
        made(spark, flow, tmp_path / "c", use_dispersion=True, **how).add("release_groups", "point", **group).run()


def test_3d_run_with_every_part(spark, flow, tmp_path):
    node, tri, field = flow
    node = node.withColumn("depth", 5 + F.col("x"))
    arrays = {n: F.array(*[F.col(n) * k for k in (0.0, 0.5, 1.0)]).alias(n) for n in ("u", "v")}
    field = field.select("node", "nt", *arrays.values(), F.array(*[F.lit(0.0)] * 3).alias("w"), (F.col("nt") * 0.1).alias("tide"), F.lit(0.05).alias("friction"))
    r = runs.Run(spark, node, tri, field, str(tmp_path), kind="sigma", axis=[0.0, 0.4, 1.0])
    r.settings(time_step=600.0, max_run_duration=7200.0, seed=3, A_H=1e-6, A_V=1e-3)
    ring = {"points": [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)], "pulse_size": 40}
    r.add("release_groups", "polygon", release_at_surface=True, **ring).add("release_groups", "polygon", z_min=-3.0, z_max=-2.0, water_depth_min=10.0, user_release_groupID=7, **ring)
    r.add("velocity_modifiers", "terminal_velocity", value=-0.01).add("resuspension", "resuspension", critical_friction_velocity=0.01)
    r.add("trajectory_modifiers", "split_particles", interval=3600.0, probability=0.5, statuses=["moving", "on_bottom"]).add("trajectory_modifiers", "cull_rate", rate=1e-5)
    tracks = r.run().cache()
    start = tracks.where("nt = 0").join(spark.read.parquet(f"{tmp_path}/released").select("id", "user_grp"), "id")
    a, b = start.where("grp = 0").collect(), start.where("grp = 1").collect()
    assert len(a) == 40 and {q.z for q in a} == {0.0} and {q.user_grp for q in a} == {0}
    assert 0 < len(b) < 40 and all(-3 <= q.z <= -2 and q.x >= 5 for q in b) and {q.user_grp for q in b} == {7}
    seen = {q.status for q in tracks.select("status").distinct().collect()}
    assert {10, 6} <= seen and tracks.where("parent is not null").count() > 0
    assert tracks.where("status > -5 and nt > 0 and (z < -water_depth - 1e-9 or z > tide + 1e-9)").count() == 0
    rows = tracks.where("nt = 3 and status > -5").collect()
    assert all(q.water_depth == pytest.approx(5 + q.x) and q.tide == pytest.approx(0.05) for q in rows)
    case = json.loads(spark.read.text(f"{tmp_path}/case").first()[0])
    assert case["is_3d"] and case["steps"] == 12 and spark.read.parquet(f"{tmp_path}/grid/tri").count() == 200


def test_dry_cells_and_downstream_groups(spark, flow, tmp_path):
    node, tri, field = flow
    dry = tri.join(node.withColumnRenamed("node", "n0"), "n0").select("tri", (F.col("x") >= 6).alias("is_dry"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("nt"))
    r = runs.Run(spark, node, tri, field, str(tmp_path), dry=dry).settings(time_step=600.0, use_dispersion=False, max_run_duration=1800.0)
    r.add("release_groups", "point", points=[(7.2, 5), (3.2, 5)]).add("release_groups", "point", points=[(7.2, 5)], allow_release_in_dry_cells=True)
    r.add("release_groups", "downstream", points=[(3.5, 5.0)], distance=0.25).add("tidal_stranding", "tidal_stranding")
    tracks = r.run()
    first = {(q.grp, round(q.x, 6), round(q.y, 6)) for q in tracks.where("nt = 0").collect()}
    assert first == {(0, 3.2, 5.0), (1, 7.2, 5.0), (2, 3.5, 4.75)}
    assert {(q.grp, q.status) for q in tracks.where("nt = 3").collect()} == {(0, 10), (1, 3), (2, 10)}


def test_parameter_files_and_command_line(spark, flow, tmp_path):
    text = """
# a run
time_step: 600.0
use_dispersion: false
max_run_duration: 3600
hindcast:
  node: NODE
  tri: TRI
  field: FIELD
release_groups:
  - class_name: point
    points: [[7, 5], [5, 8]]
    release_interval: 0
  - class_name: grid
    rows: 2
    cols: 2
    span_x: 1.0
    span_y: 1.0
    center: [5.0, 5.0]
trajectory_modifiers:
- class_name: cull_particles
  interval: 1200
  probability: 0.0
  statuses: [moving, on_bottom]
"""
    for name, df in zip(("node", "tri", "field"), flow):
        df.write.parquet(str(tmp_path / name))
        text = text.replace(name.upper(), str(tmp_path / name))
    (tmp_path / "run.yaml").write_text(text)
    given = params.plain_yaml(text)
    assert given["release_groups"][0] == {"class_name": "point", "points": [[7, 5], [5, 8]], "release_interval": 0} and given["trajectory_modifiers"][0]["statuses"] == ["moving", "on_bottom"] and given["use_dispersion"] is False
    (tmp_path / "run.json").write_text(json.dumps(given))
    assert params.read_params(str(tmp_path / "run.json")) == given == params.read_params(str(tmp_path / "run.yaml"))
    assert runs.main([str(tmp_path / "run.yaml"), "--output", str(tmp_path / "out"), "--duration", "1800"]) == 0
    rows = spark.read.parquet(str(tmp_path / "out" / "tracks"))
    assert rows.agg(F.max("nt")).first()[0] == 3 and rows.select("id").distinct().count() == 6
    with pytest.raises(params.ParameterError, match="obsolete"):
        params.merged({"root_output_dir": "x"}, params.SETTINGS, "settings")
    with pytest.raises(params.ParameterError, match="did you mean moving"):
        params.statuses(["movin"])


def test_backwards(spark, flow, tmp_path):
    there = made(spark, flow, tmp_path / "a").add("release_groups", "point", points=[(7, 5)]).run()
    end = there.where("nt = 20").first()
    back = made(spark, flow, tmp_path / "b", backtracking=True).add("release_groups", "point", points=[(end.x, end.y)]).run().where("nt = 20").first()
    assert (back.x, back.y) == pytest.approx((7, 5), abs=1e-5) and back.age == -12000


def test_users_parts(spark, flow, tmp_path):
    runs.register("particle_properties", "radius_test")(lambda t, scale: F.hypot(F.col("x") - 5, F.col("y") - 5) * scale)
    runs.register("particle_statistics", "cells_test")(lambda t, **g: stats.gridded(t, ["nt", "grp"], ("x", 0, 1, 10), ("y", 0, 1, 10), props=["radius_test"]))
    runs.register("trajectory_modifiers", "stop_test")(lambda s: s.withColumn("status", F.lit(0).cast("long")))
    r = made(spark, flow, tmp_path).add("release_groups", "grid", rows=2, cols=3, span_x=2.0, span_y=1.0, center=[5.0, 5.0])
    r.add("particle_properties", "radius_test", scale=2.0).add("particle_statistics", "cells_test").add("trajectory_modifiers", "stop_test")
    tracks = r.run()
    assert tracks.where("nt = 0").count() == 6
    seven = {x.id: (x.x, x.y) for x in tracks.where("nt = 7").collect()}
    assert seven == {x.id: (x.x, x.y) for x in tracks.where("nt = 20").collect()}  # stopped after the first block
    counts = r.results(tracks)["cells_test"]
    assert counts.agg(F.sum("n")).first()[0] == tracks.count()


def test_polygon_groups_and_cap(spark, flow, tmp_path):
    tracks = made(spark, flow, tmp_path, max_particles=30).add("release_groups", "polygon", points=[(4, 4), (6, 4), (5, 7)], pulse_size=50).run()
    first = tracks.where("nt = 0").collect()
    assert sorted(r.id for r in first) == list(range(30)) and all(4 <= r.y <= 7 for r in first)


def test_parameters():
    with pytest.raises(params.ParameterError, match="did you mean time_step"):
        params.merged({"time_stp": 1.0}, params.SETTINGS, "settings")
    for bad in ({"time_step": 0.0}, {"time_step": "x"}, {"RK_order": 3}, {"backtracking": 1}):
        with pytest.raises(params.ParameterError):
            params.merged(bad, params.SETTINGS, "settings")
    with pytest.raises(params.ParameterError, match="required"):
        params.merged({}, params.ROLES["point"], "point")
    assert params.merged({"time_step": 60}, params.SETTINGS, "s")["time_step"] == 60.0
    assert params.epoch("1970-01-02") == params.epoch("1970-01-02T01:00:00+01:00") == 86400.0
    with pytest.raises(params.ParameterError):
        runs.register("nothing", "x")


def test_readers(spark, tmp_path):
    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,4,0 5,6,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>'
    assert sources.kml_polygons(kml) == [("a", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])]
    geo = '{"features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[2, 2], [3, 3], [4, 2]]]]}}]}'
    assert [n for n, _ in sources.geojson_polygons(geo)] == ["p", ""]
    lines = ["grid", "1 3", "1 0 0 0", "2 1 0 0", "3 0 1 0", "1 3 1 2 3", "1 = open", "2 = nodes", "2", "1", "3", "0 land"]
    assert sources.gr3_open_boundaries(lines) == [[0, 2]]
    assert sources.detect(["zCoordinates", "SCHISM_hgrid_node_x", "horizontalVelX", "more"]) == "schism_v5"
    with pytest.raises(ValueError):
        sources.detect(["a"])
    state = spark.range(200).select((F.col("id") % 20).alias("nt"), F.floor(F.col("id") / 20).alias("id"), F.rand(1).alias("x"))
    sources.write_tracks(state, str(tmp_path / "t"), 6)
    back = sources.read_tracks(spark, str(tmp_path / "t"), ["x"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, state.collect()))
    some = sources.read_tracks(spark, str(tmp_path / "t"), ["x"], fraction=0.5)
    assert some.count() == 20 * some.select("id").distinct().count()
    assert sources.scan(spark, str(tmp_path / "t")).count() == 200


def test_streams(spark, tmp_path):
    obs = sources.observations(spark, "/root/testdata/sf0.001")
    poly = F.when((F.col("x") >= 20) & (F.col("x") < 60), 0).otherwise(-1).cast("long")
    rows = obs.select("id", F.timestamp_seconds("t").alias("ts"), "event_id", poly.alias("poly"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("live_counts", streaming.live_counts(stream, "ts", "1 day", "1 hour", "poly"), "complete"), ("live_events", streaming.live_events(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        q.stop()
    want = rows.groupBy(F.window("ts", "1 day").start.alias("start"), "poly").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("live_counts").collect())) == sorted(map(tuple, want.collect()))
    from driftspark.operators import events

    batch = events.edges(obs, (F.col("x") >= 20) & (F.col("x") < 60)).select("id", F.timestamp_seconds("t").alias("ts"), "flag")
    passed = obs.agg(F.max("t") - 3600).first()[0]  # what came later waits for its watermark
    want = batch.where(F.col("ts") <= F.timestamp_seconds(F.lit(passed)))
    assert sorted(map(tuple, spark.table("live_events").select("id", "ts", "flag").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_find_their_place(spark, tmp_path):
    """Files in which rows come later than newer ones, but within the watermark: the batch's events all the same."""
    import datetime as dt
    import random

    start, rnd = dt.datetime(2024, 1, 1), random.Random(4)
    rows = [(p, start + dt.timedelta(minutes=10 * k + p), 100 * k + p, rnd.choice([-1, -1, 0, 1])) for k in range(60) for p in range(3)]
    rows += [(9, start + dt.timedelta(days=3), 10**6, -1)]  # moves the watermark on
    schema = "id long, ts timestamp, event_id long, poly long"
    mixed = sorted(rows[:-1], key=lambda r: r[1] + dt.timedelta(minutes=rnd.randint(0, 50)))
    for n in range(6):
        spark.createDataFrame(mixed[n * 30 : (n + 1) * 30] if n < 5 else mixed[150:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[-1:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.live_events(stream, "2 hours").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    q.stop()
    want, inside = [], {}
    for p, ts, _, poly in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        was = inside.get(p, -1)
        if (poly >= 0) != (was >= 0):
            want.append((p, ts, poly if poly >= 0 else was, 1 if poly >= 0 else -1))
            inside[p] = poly
    assert sorted(map(tuple, spark.table("late").collect())) == sorted(want)
