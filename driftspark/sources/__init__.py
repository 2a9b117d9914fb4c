"""Tables as observations, and readers of grids, polygons and files."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as particle states: event_id, id, t, x, y, z, status, grp."""
    kind = F.col("event_type")
    status = F.when(kind == "click", 10).when(kind == "view", 6).when(kind == "purchase", 3).when(kind == "signup", 0).otherwise(-5)
    y = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"),
        y.alias("y"), (-y / 10.0).alias("z"), status.cast("long").alias("status"), (F.col("user_id") % 3).alias("grp"),
    )


def aged(obs: DataFrame) -> DataFrame:
    """With the age since each particle's first time."""
    return obs.withColumn("age", F.col("t") - F.min("t").over(Window.partitionBy("id")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings' first three components as points: id, x, y, z, grp."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("z"), F.col("label").cast("long").alias("grp")
    )


# -- files

#: Required variables that tell a format.
SIGNATURES = {
    "schism": ["SCHISM_hgrid_node_x", "zcor", "hvel"],
    "schism_v5": ["SCHISM_hgrid_node_x", "zCoordinates", "horizontalVelX"],
    "roms": ["h", "zeta", "u", "v", "s_rho", "lon_psi"],
    "glorys": ["uo", "vo", "deptho"],
    "delft3d_fm": ["mesh2d_face_nodes", "mesh2d_ucx", "mesh2d_s1"],
    "fvcom": ["nv", "siglev", "zeta", "u"],
}
#: Internal names and the variables they come from.
MAPPINGS = {
    "schism": {"x": "SCHISM_hgrid_node_x", "y": "SCHISM_hgrid_node_y", "z_interface": "zcor", "velocity": "hvel", "w": "vertical_velocity", "tide": "elev", "water_depth": "depth"},
    "schism_v5": {"x": "SCHISM_hgrid_node_x", "y": "SCHISM_hgrid_node_y", "z_interface": "zCoordinates", "u": "horizontalVelX", "v": "horizontalVelY", "tide": "elevation", "water_depth": "depth"},
    "roms": {"x": "lon_psi", "y": "lat_psi", "u": "u", "v": "v", "tide": "zeta", "water_depth": "h"},
    "glorys": {"u": "uo", "v": "vo", "w": "wo", "water_depth": "deptho"},
    "delft3d_fm": {"u": "mesh2d_ucx", "v": "mesh2d_ucy", "tide": "mesh2d_s1", "water_depth": "mesh2d_bldepth"},
    "fvcom": {"u": "u", "v": "v", "w": "ww", "tide": "zeta", "water_depth": "h"},
}


def scan(spark: SparkSession, folder: str, mask: str = "*.parquet", fmt: str = "parquet", schema=None) -> DataFrame:
    """All files below a folder whose names fit the mask."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", True).option("pathGlobFilter", mask)
    return (reader.schema(schema) if schema else reader).load(folder)


def detect(columns: list[str]) -> str:
    """The first format whose signature the columns hold."""
    for name, needed in SIGNATURES.items():
        if set(needed) <= set(columns):
            return name
    raise ValueError(f"no known format has the columns {sorted(columns)[:20]}")


def mapped(df: DataFrame, fmt: str, keys: list[str] = ()) -> DataFrame:
    """Key columns and those of a format's variables that are there, under their internal names."""
    return df.select(*keys, *[F.col(v).alias(k) for k, v in MAPPINGS[fmt].items() if v in df.columns])


def decode_time(value: Column, unit: str, epoch: float) -> Column:
    """Seconds since 1970 from a count of units since an epoch."""
    return epoch + value * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]


def time_steps(df: DataFrame, time: str = "time_sec") -> DataFrame:
    """Each distinct time and its number in order of content; a series of a dataset's steps, small by nature."""
    return df.select(time).distinct().withColumn("nt", F.row_number().over(Window.orderBy(time)) - 1)


def gaps(steps: DataFrame, key: str, time: str, usual: float) -> DataFrame:
    """Steps of less than a tenth of the usual (repeat) or over three times it (gap)."""
    dt = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time))
    kind = F.when(dt < 0.1 * usual, "repeat").when(dt > 3 * usual, "gap")
    return steps.withColumn("kind", kind).where("kind is not null")


def gr3_open_boundaries(lines: list[str]) -> list[list[int]]:
    """Node numbers (from 0) of the open boundaries of an hgrid text."""
    n_tri, n_node = map(int, lines[1].split()[:2])
    at = 2 + n_node + n_tri
    out, total = [], int(lines[at].split()[0])
    at += 2
    for _ in range(total):
        n = int(lines[at].split()[0])
        out.append([int(x.split()[0]) - 1 for x in lines[at + 1 : at + 1 + n]])
        at += n + 1
    return out


def kml_polygons(text: str) -> list[tuple[str, list[tuple[float, float]]]]:
    """(name, points) of each Placemark's outer ring."""
    ns = {"k": "http://www.opengis.net/kml/2.2"}
    out = []
    for mark in ElementTree.fromstring(text).iterfind(".//k:Placemark", ns):
        for ring in mark.iterfind(".//k:outerBoundaryIs//k:coordinates", ns):
            out.append((mark.findtext("k:name", "", ns), [tuple(map(float, p.split(",")[:2])) for p in (ring.text or "").split()]))
    return out


def geojson_polygons(text: str) -> list[tuple[str, list[tuple[float, float]]]]:
    """(name, points) of each feature's outer rings."""
    out = []
    for f in json.loads(text)["features"]:
        g = f["geometry"]
        rings = [g["coordinates"][0]] if g["type"] == "Polygon" else [p[0] for p in g["coordinates"]] if g["type"] == "MultiPolygon" else []
        out += [(str((f.get("properties") or {}).get("name", "")), [tuple(p[:2]) for p in r]) for r in rings]
    return out


def write_tracks(state: DataFrame, path: str, steps_per_block: int, columns: list[str] | None = None) -> None:
    """Long rows, a folder for each block of steps."""
    kept = state.select("nt", "id", *columns) if columns else state
    kept.withColumn("block", F.floor(F.col("nt") / steps_per_block)).write.partitionBy("block").mode("append").parquet(path)


def rectangular(state: DataFrame, columns: list[str], missing: dict | None = None, id_block: int = 100_000) -> DataFrame:
    """(nt, first, columns): a row for each step and block of particles, arrays over the block's places, null where a particle is absent.

    Places are ranks of ids, found by counts of buckets; a block has id_block places, so no row grows with the particles.
    first: the block's first place.  missing: what stands for an absent value.
    """
    from driftspark.operators.mesh import numbered

    ids = numbered(state.select("id").distinct(), "id", "place").select("id", "place")
    ends = state.agg(F.min("nt").alias("a"), F.max("nt").alias("b"))  # one row
    total = ids.agg(F.count("*").alias("total"))  # one row
    block = F.floor(F.col("place") / id_block)
    held = state.join(ids, "id").withColumn("first", (block * id_block).cast("long")).withColumn("k", (F.col("place") % id_block).cast("int"))
    packed = held.groupBy("nt", "first").agg(F.sort_array(F.collect_list(F.struct("k", F.struct(*columns).alias("v")))).alias("m"))
    blocks = total.select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(id_block).cast("long"))).alias("first"))
    frame = ends.where("a is not null").join(F.broadcast(blocks), F.lit(True)).select("first", "total", F.explode(F.sequence("a", "b")).alias("nt"))
    size = F.least(F.col("total") - F.col("first"), F.lit(id_block)).cast("int")
    twice = F.raise_error(F.lit("a particle has two states in one step")).cast("int")

    def laid_out(c: str) -> Column:
        """Each value after as many absent ones as there are places since the last: no place is searched for."""
        absent = F.lit((missing or {}).get(c)).cast(state.schema[c].dataType)

        def part(e: Column, i: Column) -> Column:
            gap = e["k"] - F.coalesce(F.get("m", i - 1)["k"], F.lit(-1)) - 1
            return F.concat(F.array_repeat(absent, F.when(gap < 0, twice).otherwise(gap)), F.array(F.coalesce(e["v"][c], absent)))

        rest = F.array_repeat(absent, size - 1 - F.element_at("m", -1)["k"])
        return F.coalesce(F.concat(F.flatten(F.transform("m", part)), rest), F.array_repeat(absent, size)).alias(c)

    arrays = [laid_out(c) for c in columns]
    return frame.join(packed, ["nt", "first"], "left").select("nt", "first", *arrays)


def merged_particles(parts: list[DataFrame], shifts: list[int]) -> DataFrame:
    """Rows of several runs, each run's particles numbered from its shift on."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [p.withColumn("id", (F.col("id") + s).cast("long")) for p, s in zip(parts, shifts)])


def pack_ragged(lists: DataFrame, key: str, name: str) -> DataFrame:
    """(key, place, value): lists of different lengths as one long column."""
    return lists.select(key, F.posexplode(name).alias("place", "value"))


def unpack_ragged(packed: DataFrame, key: str, name: str) -> DataFrame:
    """The lists again."""
    held = packed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("_v"))
    return held.select(key, F.transform("_v", lambda x: x["value"]).alias(name))


def read_result(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A run's tables: tracks, released, grid/node, grid/tri, case, or results/<name> of a statistic or an event log."""
    return spark.read.text(f"{folder}/{kind}") if kind == "case" else spark.read.parquet(f"{folder}/{kind}")


def read_tracks(spark: SparkSession, path: str, columns: list[str] | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Wanted columns, of a share of the particles: the same particles whatever the partitions."""
    from driftspark.functions import uniform

    df = spark.read.parquet(path)
    df = df.where(uniform(seed, "id") < fraction) if fraction is not None else df
    return df.select("nt", "id", *columns) if columns else df
