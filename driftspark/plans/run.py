"""A run: parameters in, tracks out, statistics over the tracks.

    run = Run(spark, mesh_node, mesh_tri, field, "out").settings(time_step=600).add("release_groups", kind="point", points=[(1, 2)])
    tracks = run.run()

Time is cut into blocks of ``steps_per_block`` steps.  Each block is one job: the state goes through the step
kernel (no shuffle), its track rows are appended as a folder of their own, and the last state is written as a
checkpoint from which ``run(restart=True)`` goes on.  Tables are in ``folder``, which all executors share.
A 2-D field whose block is too large to send is stepped by joins.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark import enums
from driftspark.functions import c, uniform
from driftspark.operators import dynamics, kernel, mesh, release, spatial
from driftspark.params import PARTS, ROLES, SETTINGS, ParameterError, merged, read_params, statuses

#: Users' own parts by role and name: functions of DataFrames or Columns.
REGISTRY: dict[str, dict[str, Callable]] = {
    "particle_properties": {}, "particle_statistics": {}, "trajectory_modifiers": {}, "event_loggers": {}, "release_groups": {}, "release_filters": {}, "velocity_modifiers": {}, "dispersion": {}, "resuspension": {}, "tidal_stranding": {},
}


def register(role: str, name: str):
    """Adds a function to a role: a property gives a Column, a statistic or logger a DataFrame of the tracks, a modifier a state of a state,
    a release filter a Column over what is to be released."""
    if role not in REGISTRY:
        raise ParameterError(f"no role {role}; there are {sorted(REGISTRY)}")

    def add(function: Callable) -> Callable:
        REGISTRY[role][name] = function
        return function

    return add


class Run:
    def __init__(self, spark: SparkSession, node: DataFrame, tri: DataFrame, field: DataFrame, folder: str, field_dt: float = 3600.0, open_nodes: DataFrame | None = None, kind: str | None = None, axis: list[float] | None = None, dry: DataFrame | None = None):
        """field: (nt, node, u, v, ...), nt from 0; field_dt: seconds between its steps; open_nodes: column node.

        3-D, dry: as kernel.field_block() takes them; node may have depth and bottom.
        """
        self.spark, self.node, self.tri, self.field, self.folder, self.field_dt = spark, node, tri, field, folder, float(field_dt)
        self.kind, self.axis, self.dry = kind, axis, dry
        adj = mesh.adjacency(tri)
        if open_nodes is not None:
            types = node.select("node").join(open_nodes.select("node", F.lit(enums.OPEN_NODE).alias("t")), "node", "left")
            adj = mesh.open_faces(tri, adj, types.select("node", F.coalesce("t", F.lit(0)).alias("node_type")))
        self.adj = adj
        self.given, self.parts = {}, {role: [] for role in REGISTRY}
        self._top: int | None = None

    def settings(self, **given) -> Run:
        self.given |= given
        return self

    def add(self, role: str, kind: str, **given) -> Run:
        if role not in REGISTRY:
            raise ParameterError(f"no role {role}; there are {sorted(REGISTRY)}")
        known = ROLES if role == "release_groups" else PARTS.get(role, {})
        if kind in known:
            given = merged(given, known[kind], f"{role}.{kind}")
        elif kind not in REGISTRY[role]:
            raise ParameterError(f"{role} has no {kind}")
        self.parts[role].append((kind, given))
        return self

    def configure(self, given: dict) -> Run:
        """Settings and parts as a parameter file has them: settings by name, and roles with lists of maps with class_name."""
        own = {k: v for k, v in given.items() if k not in REGISTRY}
        self.settings(**own)
        for role, parts in given.items():
            for part in parts if role in REGISTRY else ():
                part = dict(part)
                self.add(role, part.pop("class_name"), **part)
        return self

    @property
    def top(self) -> int:
        """The field's last step."""
        if self._top is None:
            self._top = int(self.field.agg(F.max("nt")).first()[0])
        return self._top

    def rules(self, how: dict) -> kernel.Rules:
        """What the kernel does in each step, from the settings and the parts that it knows."""
        dt = how["time_step"]
        every = lambda interval: max(1, round(interval / dt))
        out = {
            "order": how["RK_order"], "use_open": how["use_open_boundary"], "block_dry": how["block_dry_cells"], "seed": how["seed"], "direction": -1 if how["backtracking"] else 1,
            "z0": how["z0"], "least_depth": how["minimum_total_water_depth"], "density": how["water_density"],
        }
        if how["use_dispersion"]:
            out |= {"spread": how["A_H"], "spread_z": how["A_V"], "use_profile": how["use_A_Z_profile"]}
        for role in PARTS:
            for kind, g in self.parts[role]:
                if kind == "terminal_velocity":
                    out["fall"] = out.get("fall", 0.0) + g["value"]
                elif kind == "rheotaxis":
                    out |= {"swim": g["swim_speed"], "swim_focus": g["concentration"]}
                elif kind == "random_walk" and how["use_dispersion"]:
                    out |= {"spread": g["A_H"], "spread_z": g["A_V"]}
                elif kind in ("resuspension", "basic_resuspension") and how["use_resuspension"]:
                    out |= {"critical": g["critical_friction_velocity"], "basic_lift": kind == "basic_resuspension"}
                elif kind == "tidal_stranding":
                    out["strand"] = True
                elif kind == "split_particles":
                    out |= {"split": g["probability"], "split_every": every(g["interval"]), "split_statuses": statuses(g["statuses"]), "split_ages": (g["min_age"], g["max_age"])}
                elif kind == "cull_particles":
                    out |= {"cull": g["probability"], "cull_every": every(g["interval"]), "cull_statuses": statuses(g["statuses"])}
                elif kind == "cull_rate":
                    out["cull_rate"] = g["rate"]
                elif kind == "settle_in_polygon":
                    out |= {"settle": g["points"], "settle_chance": g["probability_of_settlement"], "settle_time": g["settlement_duration"]}
                elif kind == "surface_float":
                    out["floats"] = True
        return kernel.Rules(**out)

    def released(self, how: dict, last: int, start: float) -> DataFrame:
        """All particles with their ids and the steps at which they begin: known before anything moves."""
        dt, groups = how["time_step"], None
        for n, (kind, g) in enumerate(self.parts["release_groups"]):
            if kind in ROLES:
                begin = start if g["start"] is None else max(start, g["start"])
                stop = g["end"] if g["end"] is not None else begin + g["duration"] if g["duration"] is not None else start + last * dt
                steps = release.interval_steps(begin, min(stop, start + last * dt), dt, g["release_interval"])
                first = int(round((begin - start) / dt))
                if kind == "polygon":  # each pulse has points of its own
                    points = release.polygon_points(self.spark, g["points"], g["pulse_size"] * len(steps), how["seed"] + n)
                    pulse = F.floor(F.col("pt") / g["pulse_size"])
                    rows = points.select("x", "y", F.lit(n).cast("long").alias("grp"), (first + pulse * steps.step).cast("long").alias("nt"), (F.col("pt") % g["pulse_size"]).alias("pt"), F.lit(0).alias("copy"))
                else:
                    points = self._points(kind, g)
                    rows = release.pulses(points.withColumn("grp", F.lit(n).cast("long")), steps, g["pulse_size"], first)
                if kind == "radius":
                    rows = release.radius_points(rows, g["radius"], how["seed"] + n)
                rows = rows.select("nt", "grp", "pt", "copy", "x", "y", F.lit(g["max_age"]).cast("double").alias("max_age"), F.lit(g["user_release_groupID"]).cast("long").alias("user_grp"))
            else:
                rows = REGISTRY["release_groups"][kind](self.spark, **g)
                rows = rows if "user_grp" in rows.columns else rows.withColumn("user_grp", F.lit(0).cast("long"))
            groups = rows if groups is None else groups.unionByName(rows)
        if groups is None:
            raise ParameterError("a run needs a release group")
        for kind, g in self.parts["release_filters"]:
            groups = groups.where(REGISTRY["release_filters"][kind](groups, **g))
        size = groups.agg(*[F.coalesce(F.max(n) + 1, F.lit(1)).alias(n) for n in ("grp", "pt", "copy")]).first()
        out = release.assign_ids(groups, int(size.grp), int(size.pt), int(size.copy))
        return out.where(F.col("id") < how["max_particles"]).select("id", "nt", "grp", "user_grp", "x", "y", "max_age")

    def _points(self, kind: str, g: dict) -> DataFrame:
        if kind == "grid":
            return release.grid_points(self.spark, g["rows"], g["cols"], g["span_x"], g["span_y"], *g["center"]).select("pt", "x", "y")
        points = self.spark.createDataFrame([(k, *p[:2]) for k, p in enumerate(g["points"])], "pt long, x double, y double")
        if kind == "downstream":
            at = spatial.locate(points.withColumn("t", F.lit(0.0)), self._triangles, self._size)
            for name in ("u", "v"):
                value = F.col(name) if self.kind is None else F.element_at(name, -1)  # the surface
                got = spatial.interpolate(at, self.field.where("nt <= 1").select("node", "nt", value.alias("val")), "pt")
                points = points.join(got.withColumnRenamed("val", name), "pt")
            points = release.downstream(points, g["distance"]).select("pt", "x", "y")
        return points

    @property
    def _triangles(self) -> DataFrame:
        return spatial.corners(self.tri.select("tri", "n0", "n1", "n2"), self.node.select("node", "x", "y"))

    @property
    def _size(self) -> float:
        span = self.node.agg(F.max("x") - F.min("x")).first()[0] / max(1.0, self.tri.count() ** 0.5)
        return max(span, 1e-9)

    def placed(self, how: dict, last: int, per: float) -> DataFrame:
        """The released particles that lie on the mesh, in water of the depths that their groups ask for, with z."""
        rows = spatial.locate(self.released(how, last, 0.0), self._triangles, self._size)
        groups = [g if kind in ROLES else {} for kind, g in self.parts["release_groups"]]
        own = lambda name, default=None: F.coalesce(*[F.when(F.col("grp") == n, F.lit(g.get(name, default))) for n, g in enumerate(groups) if g.get(name, default) is not None], F.lit(None))
        depth = tide = F.lit(0.0)
        if "depth" in self.node.columns:
            rows = spatial.at_points(rows, self.node.select("node", F.col("depth").alias("val")), "water_depth")
            depth = F.col("water_depth")
            low, high = own("water_depth_min"), own("water_depth_max")
            rows = rows.where((low.isNull() | (depth >= low)) & (high.isNull() | (depth <= high)))
        if "tide" in self.field.columns and self.kind is not None:
            field_t = F.least(F.col("nt") * per, F.lit(float(self.top))) if not how["backtracking"] else F.greatest(self.top - F.col("nt") * per, F.lit(0.0))
            timed = rows.withColumn("t", field_t)
            got = spatial.interpolate(timed, self.field.select("node", "nt", F.col("tide").alias("val")), "id").withColumnRenamed("val", "tide")
            rows = rows.join(got, "id", "left")
            tide = F.coalesce("tide", F.lit(0.0))
        if self.dry is not None and not all(g.get("allow_release_in_dry_cells", False) for g in groups):
            step = F.floor(F.col("nt") * per).cast("long")
            wet = rows.withColumn("_step", step if not how["backtracking"] else (self.top - step)).join(self.dry.select(F.col("nt").alias("_step"), "tri", "is_dry"), ["_step", "tri"], "left")
            rows = wet.where(~F.coalesce(F.col("is_dry").cast("boolean"), F.lit(False)) | F.coalesce(own("allow_release_in_dry_cells"), F.lit(False))).drop("_step", "is_dry")
        z = F.lit(0.0)
        if self.kind is not None:
            offset = F.coalesce(own("release_offset_from_surface_or_bottom"), F.lit(0.0))
            low = F.greatest(-depth, F.coalesce(own("z_min"), -depth))
            high = F.least(tide, F.coalesce(own("z_max"), tide))
            between = low + uniform(how["seed"], "id", F.lit("z")) * (high - low)
            z = F.when(own("release_at_surface", False), F.greatest(tide - offset, -depth)).when(own("release_at_bottom", False), F.least(-depth + offset, tide)).otherwise(between)
        return rows.withColumn("z", c(z)).select("id", "nt", "grp", "user_grp", "x", "y", "z", "max_age", "tri")

    def run(self, restart: bool = False) -> DataFrame:
        """Tracks: nt, id, grp, x, y, z, tri, status, tide, water_depth, parent, age, time_sec, and the users' properties.

        A particle that dies has one last row, with the status of the dead.
        """
        began = time.time()
        how = merged(self.given, SETTINGS, "settings")
        dt = how["time_step"]
        per = dt / self.field_dt
        sign = -1 if how["backtracking"] else 1
        last = int(self.top / per + 1e-9)
        if how["max_run_duration"] is not None:
            last = min(last, int(how["max_run_duration"] / dt + 1e-9))
        spark, folder = self.spark, self.folder
        if not restart:
            self.placed(how, last, per).write.mode("overwrite").parquet(f"{folder}/released")
            self.write_grid()
        born = spark.read.parquet(f"{folder}/released").drop("user_grp")
        block_steps, rules = how["steps_per_block"], self.rules(how)
        done = self._done() if restart else -1
        for b in range(done + 1, max(1, -(-last // block_steps))):
            a, z = b * block_steps, min(last, (b + 1) * block_steps)
            before = spark.read.parquet(f"{folder}/state/block={b - 1}") if b else None
            self._block(before, born, how, rules, a, z, z == last, per, sign).write.mode("overwrite").parquet(f"{folder}/tracks/block={b}")
            keep = spark.read.parquet(f"{folder}/tracks/block={b}").where((F.col("nt") == z) & (F.col("status") > enums.DEAD))
            for kind, g in self.parts["trajectory_modifiers"]:
                if kind not in PARTS["trajectory_modifiers"]:
                    keep = REGISTRY["trajectory_modifiers"][kind](keep, **g)
            keep.write.mode("overwrite").parquet(f"{folder}/state/block={b}")
        tracks = self.tracks(how)
        self.write_case(how, last, began)
        return tracks

    def tracks(self, how: dict | None = None) -> DataFrame:
        """What has been written, with ages, times and the users' properties."""
        how = merged(self.given, SETTINGS, "settings") if how is None else how
        step = (-1 if how["backtracking"] else 1) * how["time_step"]
        tracks = self.spark.read.parquet(f"{self.folder}/tracks").drop("block", "settled", "nz", "zf")
        tracks = tracks.withColumn("age", (F.col("nt") - F.col("born")) * step).withColumn("time_sec", F.col("nt") * step).drop("born", "max_age")
        for kind, g in self.parts["particle_properties"]:
            tracks = tracks.withColumn(kind, REGISTRY["particle_properties"][kind](tracks, **g))
        return tracks

    def results(self, tracks: DataFrame, write: bool = False) -> dict[str, DataFrame]:
        """The statistics and event logs of a run, by name; written as tables below the folder if asked, and read from there."""
        out = {kind: REGISTRY[role][kind](tracks, **g) for role in ("particle_statistics", "event_loggers") for kind, g in self.parts[role]}
        if write:
            for name, df in out.items():
                df.write.mode("overwrite").parquet(f"{self.folder}/results/{name}")
            out = {name: self.spark.read.parquet(f"{self.folder}/results/{name}") for name in out}
        return out

    def write_grid(self) -> None:
        """The mesh as tables: nodes, triangles with their neighbours."""
        self.node.write.mode("overwrite").parquet(f"{self.folder}/grid/node")
        self.tri.select("tri", "n0", "n1", "n2").join(self.adj, "tri").write.mode("overwrite").parquet(f"{self.folder}/grid/tri")

    def write_case(self, how: dict, last: int, began: float) -> None:
        """Parameters, times and counts as JSON beside the tables; one row."""
        case = {
            "settings": how, "parts": {role: [{"class_name": kind, **g} for kind, g in parts] for role, parts in self.parts.items() if parts},
            "steps": last, "seconds": round(time.time() - began, 3), "is_3d": self.kind is not None, "spark": self.spark.version, "tables": ["released", "tracks", "state", "grid/node", "grid/tri", "results"],
        }
        text = json.dumps(case, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/case")

    def _done(self) -> int:
        """The last block whose state was written whole."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = [p for p in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max([int(p.getName().partition("=")[2]) for p in whole], default=-1)

    def _block(self, before: DataFrame | None, born: DataFrame, how: dict, rules: kernel.Rules, a: int, z: int, ends: bool, per: float, sign: int) -> DataFrame:
        """Track rows of the steps from a to z: what is released there, and what was or is moved since."""
        new = born.where((F.col("nt") >= a) & (F.col("nt") <= z if ends else F.col("nt") < z))
        new = new.withColumn("born", F.col("nt")).withColumn("status", F.lit(enums.MOVING).cast("long"))
        empty = {"settled": "long", "parent": "long", "tide": "double", "water_depth": "double", "nz": "int", "zf": "double"}
        for name, kind in empty.items():
            new = new.withColumn(name, F.lit(None).cast(kind))
        columns = [name for name, _ in kernel.COLUMNS]
        new = new.select(columns)
        state = new if before is None else before.select(columns).unionByName(new)
        fields, top = self.field, self.top
        if sign < 0:
            flip = lambda n: F.transform(n, lambda x: -x) if self.kind is not None else -F.col(n)
            turned = {n: flip(n).alias(n) for n in ("u", "v", "w") if n in fields.columns}
            fields = fields.select((top - F.col("nt")).alias("nt"), *[turned.get(n, F.col(n)) for n in fields.columns if n != "nt"])
        dry = self.dry if self.dry is None or sign > 0 else self.dry.withColumn("nt", top - F.col("nt"))
        first = min(int(a * per), top - 1)
        block = kernel.field_block(self.node, self.tri, self.adj, fields, first, min(math.ceil(z * per) + 1, top), self.field_dt, self.kind, self.axis, dry, how["use_geographic_coords"])
        if block is not None:
            moved = kernel.step_block(state, block, z - a, per, base=a, offset=a * per - first, rules=rules)
        else:
            moved = self._by_joins(state, fields, rules, a, z, per)
        return moved.select(columns).unionByName(new)

    def _by_joins(self, state: DataFrame, fields: DataFrame, rules: kernel.Rules, a: int, z: int, per: float) -> DataFrame:
        """The same steps by joins, each a table of its own, for 2-D fields that are too large to send."""
        if self.kind is not None or rules != kernel.Rules(order=rules.order, block_dry=rules.block_dry, seed=rules.seed, direction=rules.direction, z0=rules.z0, least_depth=rules.least_depth, density=rules.density, spread_z=rules.spread_z):
            raise ValueError("the field's block is too large to send, and only plain 2-D movement can be stepped by joins: take fewer steps_per_block")
        triangles, size, out = self._triangles, self._size, []
        dt = self.field_dt * per
        for n in range(a, z):
            waits = state.where(F.col("nt") > n)
            old = F.col("max_age").isNotNull() & ((n - F.col("born")) * dt > F.col("max_age"))
            here = state.where(F.col("nt") <= n).withColumn("status", F.when(old, enums.DEAD).otherwise(F.col("status")).cast("long"))
            timed = here.select("id", F.col("nt").alias("at"), (F.lit(n) * per).alias("nt"), "x", "y", "status")
            moved = dynamics.step_by_joins(timed.drop("at"), triangles, fields, dt, size, rules.order, per).select("id", F.col("x").alias("x2"), F.col("y").alias("y2"))
            step = here.join(moved, "id").withColumn("nt", F.lit(n + 1).cast("long")).withColumn("x", F.col("x2")).withColumn("y", F.col("y2")).drop("x2", "y2")
            path = f"{self.folder}/steps/nt={n + 1}"
            step.write.mode("overwrite").parquet(path)
            step = self.spark.read.schema(step.schema).parquet(path)
            out.append(step)
            state = step.where(F.col("status") > enums.DEAD).unionByName(waits.select(step.columns))
        return reduce(DataFrame.unionByName, out)


def property_of(column: Column) -> Callable:
    """A property that is a plain expression, to register."""
    return lambda tracks: column


def main(args: list[str] | None = None) -> int:
    """Runs a parameter file: python -m driftspark.plans.run FILE [--duration SECONDS] [--output FOLDER].

    The file has settings, parts, and under "hindcast" the folders of the tables node, tri and field, and field_dt.
    """
    import argparse

    from driftspark.session import session

    ask = argparse.ArgumentParser(prog="driftspark", description=main.__doc__)
    ask.add_argument("file")
    ask.add_argument("--duration", type=float, help="run no longer than so many seconds")
    ask.add_argument("--output", help="folder of the results")
    ask.add_argument("--cores", default="*")
    got = ask.parse_args(args)
    given = dict(read_params(got.file))
    source = given.pop("hindcast")
    if got.duration is not None:
        given["max_run_duration"] = got.duration
    folder = got.output or given.get("run_output_dir") or str(Path(got.file).with_suffix(""))
    spark = session("run", cores=got.cores)
    tables = [spark.read.parquet(source[n]) for n in ("node", "tri", "field")]
    made = Run(spark, *tables, folder, source.get("field_dt", 3600.0), kind=source.get("kind"), axis=source.get("axis")).configure(given)
    made.results(made.run(), write=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
