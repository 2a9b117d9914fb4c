"""Points in polygons and in triangles, by equality joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions import between, side


def polygon_edges(spark: SparkSession, polygons: list[list[tuple[float, float]]]) -> DataFrame:
    """poly, x1, y1, x2, y2; rings are closed."""
    rows = []
    for i, ring in enumerate(polygons):
        ring = [*ring, ring[0]] if ring[0] != ring[-1] else ring
        rows += [(i, float(a), float(b), float(p), float(q)) for (a, b), (p, q) in zip(ring, ring[1:])]
    return spark.createDataFrame(rows, "poly long, x1 double, y1 double, x2 double, y2 double")


def inside(points: DataFrame, edges: DataFrame, key: str, height: float) -> DataFrame:
    """(key, poly) of points in polygons: each crossing of a ray to the right, counted modulo 2.

    Edges are exploded over strips of the given height, so the join is one of equal strips.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    strips = edges.withColumn("strip", F.explode(F.sequence(F.floor(low / height), F.floor(high / height))))
    at = points.select(key, "x", "y", F.floor(F.col("y") / height).alias("strip"))
    hits = at.join(strips, "strip").where(side("x", "y", "x1", "y1", "x2", "y2"))
    return hits.groupBy(key, "poly").agg(F.count("*").alias("n")).where("n % 2 = 1").select(key, "poly")


#: Up to so many edges are an expression rather than a join.
EDGES_INLINE = 500


def polygon_of(points: DataFrame, edges: DataFrame, key: str, height: float) -> DataFrame:
    """points with poly, the last polygon that holds each, or -1.

    A few edges are one array that each row goes through, without a shuffle; more are joined by strips.
    """
    few = edges.limit(EDGES_INLINE + 1).collect()
    if len(few) <= EDGES_INLINE:
        return points.withColumn("poly", last_polygon(few))
    last = inside(points, edges, key, height).groupBy(key).agg(F.max("poly").alias("poly"))
    return points.join(last, key, "left").withColumn("poly", F.coalesce("poly", F.lit(-1).cast("long")))


def last_polygon(edges: list) -> Column:
    """The last polygon that holds (x, y), or -1, from rows (poly, x1, y1, x2, y2)."""
    by_poly: dict[int, list] = {}
    for e in edges:
        by_poly.setdefault(e[0], []).append(e)
    out = F.lit(-1).cast("long")
    for poly, own in sorted(by_poly.items()):
        sides = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e[1:])]) for e in own])
        crossed = F.size(F.filter(sides, lambda s: side("x", "y", s["x1"], s["y1"], s["x2"], s["y2"])))
        low_x, high_x = min(min(e[1], e[3]) for e in own), max(max(e[1], e[3]) for e in own)
        low_y, high_y = min(min(e[2], e[4]) for e in own), max(max(e[2], e[4]) for e in own)
        box = between("x", low_x, high_x) & between("y", low_y, high_y)
        out = F.when(box & (crossed % 2 == 1), F.lit(poly).cast("long")).otherwise(out)
    return out


def corners(tri: DataFrame, node: DataFrame) -> DataFrame:
    """Triangles (tri, n0, n1, n2) with their corners' coordinates and determinant."""
    out = tri
    for i in range(3):
        out = out.join(node.select(F.col("node").alias(f"n{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")), f"n{i}")
    return out.withColumn("det", F.expr("(x0-x2)*(y1-y2)-(x1-x2)*(y0-y2)"))


def locate(points: DataFrame, triangles: DataFrame, size: float, tolerance: float = 1e-9) -> DataFrame:
    """points with tri, n0..n2 and barycentric b0..b2; the smallest triangle number on shared edges.

    triangles: corners().  Each is exploded over the cells of the given size that its box touches.
    """
    t = triangles
    for a in "xy":
        low, high = F.least(*[f"{a}{i}" for i in range(3)]), F.greatest(*[f"{a}{i}" for i in range(3)])
        t = t.withColumn(f"b{a}", F.explode(F.sequence(F.floor((low - tolerance) / size), F.floor((high + tolerance) / size))))
    p = points.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))
    hit = p.join(t, ["bx", "by"]).withColumn("b0", F.expr("((y1-y2)*(x-x2)+(x2-x1)*(y-y2))/det")).withColumn("b1", F.expr("((y2-y0)*(x-x2)+(x0-x2)*(y-y2))/det"))
    hit = hit.withColumn("b2", 1 - F.col("b0") - F.col("b1")).where(F.least("b0", "b1", "b2") > -tolerance)
    first = F.min_by(F.struct("n0", "n1", "n2", "b0", "b1", "b2", "tri"), "tri").alias("h")
    # equal points hit the same triangles, so their number is that of all hits by that of a point's own
    copies = (F.count("*") / F.size(F.collect_set("tri"))).cast("int").alias("_copies")
    found = hit.groupBy(*points.columns).agg(first, copies)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*points.columns, "h.*")


def at_points(located: DataFrame, node_value: DataFrame, name: str) -> DataFrame:
    """located (n0..n2, b0..b2) with a static field (node, val), linear in each triangle, as a column of that name."""
    out = located
    for i in range(3):
        out = out.join(node_value.select(F.col("node").alias(f"n{i}"), F.col("val").alias(f"_v{i}")), f"n{i}", "left")
    value = sum((F.col(f"b{i}") * F.col(f"_v{i}") for i in range(3)), F.lit(0.0))
    return out.withColumn(name, value).drop("_v0", "_v1", "_v2")


def interpolate(located: DataFrame, field: DataFrame, key: str) -> DataFrame:
    """Weighted sums of a field (node, nt, val) at located points with time t in steps: linear in space and time."""
    nt, part = F.floor("t"), F.col("t") - F.floor("t")
    parts = [
        F.struct(F.col(f"n{i}").alias("node"), (nt + k).alias("nt"), (F.col(f"b{i}") * w).alias("w"))
        for i in range(3) for k, w in ((0, 1 - part), (1, part))
    ]
    v = located.select(key, F.explode(F.array(*parts)).alias("q")).select(key, "q.node", "q.nt", "q.w").where("w <> 0")
    return v.join(field, ["node", "nt"]).groupBy(key).agg(F.sum(F.col("w") * F.col("val")).alias("val"))
