"""Triangular meshes: lattices, splitting, adjacency, boundaries, node types, areas.

Tables: node (node, x, y), cell (cell, n0..n3; n3 null in triangles), tri (tri, n0, n1, n2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspark import enums
from driftspark.functions import degrees_per_metre


def numbered(df: DataFrame, key: str, name: str, width: int = 100_000) -> DataFrame:
    """df with its rank (from 0) by an integer key, without bringing all rows to one task.

    Rows are ranked within buckets of the key; only the buckets' counts are summed over all.  Equal keys get
    ranks in no defined order.
    """
    bucket = F.floor(F.col(key) / width).cast("long")
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return rows.withColumn("_nth", nth).join(sizes, "_bucket").withColumn(name, F.col("_before") + F.col("_nth")).drop("_bucket", "_nth", "_before")


def lattice(spark: SparkSession, rows: int, cols: int, spacing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and quad cells of a regular grid; node = row * cols + column."""
    node = spark.range(rows * cols).select(F.col("id").alias("node"), ((F.col("id") % cols) * spacing).alias("x"), (F.floor(F.col("id") / cols) * spacing).alias("y"))
    q = spark.range((rows - 1) * (cols - 1)).select(F.col("id").alias("cell"), (F.floor(F.col("id") / (cols - 1)) * cols + F.col("id") % (cols - 1)).alias("n0"))
    return node, q.select("cell", "n0", (F.col("n0") + 1).alias("n1"), (F.col("n0") + cols + 1).alias("n2"), (F.col("n0") + cols).alias("n3"))


def land_filter(cells: DataFrame, land: DataFrame) -> DataFrame:
    """Quads with fewer than three corners on land (column node)."""
    corner = cells.select("cell", F.explode(F.array("n0", "n1", "n2", "n3")).alias("node"))
    wet = corner.join(land.withColumn("_land", F.lit(1)), "node", "left").groupBy("cell").agg(F.count("_land").alias("_n")).where("_n < 3")
    return cells.join(wet.select("cell"), "cell", "left_semi")


def split_quads(cells: DataFrame) -> DataFrame:
    """Triangles (tri, cell, n0, n1, n2): corners 0, 1, 2 under the cell's number, and 0, 2, 3 of quads after all cells."""
    count = cells.agg((F.max("cell") + 1).alias("_cells"))
    first = cells.select(F.col("cell").alias("tri"), "cell", "n0", "n1", "n2")
    second = numbered(cells.where("n3 is not null"), "cell", "_rank").join(F.broadcast(count), F.lit(True))  # count is one row
    return first.union(second.select((F.col("_cells") + F.col("_rank")).alias("tri"), "cell", "n0", F.col("n2").alias("n1"), F.col("n3").alias("n2")))


def cell_data(triangles: DataFrame, data: DataFrame) -> DataFrame:
    """Data of cells (cell, ...) for each of their triangles."""
    return triangles.select("tri", "cell").join(data, "cell").drop("cell")


def node_triangles(tri: DataFrame) -> DataFrame:
    """(node, tris): rising numbers of the triangles at each node; a mesh bounds how many."""
    pairs = tri.select("tri", F.explode(F.array("n0", "n1", "n2")).alias("node"))
    return pairs.groupBy("node").agg(F.sort_array(F.collect_list("tri")).alias("tris"))


def faces(tri: DataFrame) -> DataFrame:
    """(tri, face, a, b): face m is opposite to corner m, a < b."""
    face = F.explode(F.array(*[F.struct(F.lit(m).alias("face"), F.col(f"n{(m + 1) % 3}").alias("p"), F.col(f"n{(m + 2) % 3}").alias("q")) for m in range(3)]))
    return tri.select("tri", face.alias("f")).select("tri", "f.face", F.least("f.p", "f.q").alias("a"), F.greatest("f.p", "f.q").alias("b"))


def adjacency(tri: DataFrame) -> DataFrame:
    """(tri, adj0, adj1, adj2): the triangle beyond each face, -1 at the boundary."""
    f = faces(tri)
    span = f.groupBy("a", "b").agg(F.min("tri").alias("lo"), F.max("tri").alias("hi"))
    other = F.when(F.col("lo") == F.col("hi"), enums.DOMAIN_EDGE).when(F.col("lo") == F.col("tri"), F.col("hi")).otherwise(F.col("lo")).cast("long")
    joined = f.join(span, ["a", "b"]).withColumn("other", other)
    return joined.groupBy("tri").agg(*[F.max(F.when(F.col("face") == m, F.col("other"))).alias(f"adj{m}") for m in range(3)])


def boundary_triangles(adj: DataFrame) -> DataFrame:
    return adj.where(F.least("adj0", "adj1", "adj2") < 0).select("tri")


def boundary_edges(tri: DataFrame) -> DataFrame:
    """(a, b): faces that one triangle holds alone."""
    return faces(tri).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")


def boundary_rings(tri: DataFrame) -> DataFrame:
    """(node, ring): the boundary's nodes by connected ring, named by its smallest node; by joins alone, whatever the mesh's size.

    Each round a node takes the smallest name among its neighbours, and then that name's own, so names run along a ring in
    a logarithm of its length; rounds end in a checkpoint.
    """
    spark = tri.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or "/tmp/checkpoints")
    edges = boundary_edges(tri)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).checkpoint()
    names = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("ring")).checkpoint()
    while True:
        least = both.join(names.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("ring").alias("low"))
        lower = names.join(least, "node").select("node", "ring", F.least("ring", "low").alias("low"))
        jump = lower.join(names.select(F.col("node").alias("low"), F.col("ring").alias("far")), "low", "left")
        after = jump.select("node", F.least("low", F.coalesce("far", "low")).alias("ring"), (F.least("low", F.coalesce("far", "low")) < F.col("ring")).alias("moved")).checkpoint()
        if after.where("moved").isEmpty():
            return after.select("node", "ring")
        names = after.select("node", "ring")


def rings_by_kind(tri: DataFrame, node: DataFrame) -> DataFrame:
    """(node, ring, is_domain): the ring that holds the node of the smallest x is the domain's, the others are islands."""
    found = boundary_rings(tri)
    first = found.join(node.select("node", "x"), "node").agg(F.min_by("ring", F.struct("x", "node")).alias("domain"))  # one row
    return found.join(F.broadcast(first), F.lit(True)).select("node", "ring", (F.col("ring") == F.col("domain")).alias("is_domain"))


def rings(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Closed rings of nodes from boundary edges; where rings touch, one goes on with the smallest node."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    left = {(min(e), max(e)) for e in edges}
    out = []
    while left:
        start, now = min(left)
        ring = [start]
        left.discard((start, now))
        while now != start:
            ring.append(now)
            ahead = sorted(n for n in near[now] if (min(n, now), max(n, now)) in left)
            if not ahead:
                break
            left.discard((min(now, ahead[0]), max(now, ahead[0])))
            now = ahead[0]
        out.append(ring)
    return out


def outline(tri: DataFrame, node: DataFrame, most: int = 5_000_000) -> tuple[list[int], list[list[int]]]:
    """The domain's ring (the one with the smallest x) and the islands' rings.

    Rings are chained on the driver; a mesh with more than ``most`` boundary edges is refused.
    """
    edges = boundary_edges(tri).limit(most + 1).collect()
    if len(edges) > most:
        raise ValueError(f"more than {most} boundary edges")
    found = rings([(r.a, r.b) for r in edges])
    held = tri.sparkSession.createDataFrame([(k, n) for k, ring in enumerate(found) for n in ring], "ring long, node long")
    first = held.join(node, "node").groupBy("ring").agg(F.min("x").alias("x")).orderBy("x", "ring").first()
    return found[first.ring], [r for k, r in enumerate(found) if k != first.ring]


def domain_mask(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """points (x, y, ...) with masked: whether they lie outside the domain's ring."""
    from driftspark.operators.spatial import last_polygon

    closed = [*ring, ring[0]] if ring[0] != ring[-1] else ring
    edges = [(0, *p, *q) for p, q in zip(closed, closed[1:])]
    return points.withColumn("masked", last_polygon(edges) < 0)


def node_types(node: DataFrame, tri: DataFrame, domain: DataFrame, island: DataFrame, open_: DataFrame) -> DataFrame:
    """(node, node_type); domain, island and open_ have a column node.  Later kinds go over earlier ones."""
    in_mesh = tri.select(F.explode(F.array("n0", "n1", "n2")).alias("node")).distinct()
    out = node.select("node").withColumn("node_type", F.lit(enums.LAND_NODE))
    for rows, code in ((in_mesh, enums.INTERIOR_NODE), (island, enums.ISLAND_NODE), (domain, enums.DOMAIN_NODE), (open_, enums.OPEN_NODE)):
        out = out.join(rows.select("node").distinct().withColumn("_code", F.lit(code)), "node", "left")
        out = out.select("node", F.coalesce("_code", "node_type").alias("node_type"))
    return out


def open_faces(tri: DataFrame, adj: DataFrame, types: DataFrame) -> DataFrame:
    """Adjacency with the boundary faces between two open nodes marked open."""
    out = tri.join(adj, "tri")
    for m in range(3):
        out = out.join(types.select(F.col("node").alias(f"n{m}"), (F.col("node_type") == enums.OPEN_NODE).alias(f"open{m}")), f"n{m}", "left")
    marked = [F.when((F.col(f"adj{m}") < 0) & F.col(f"open{(m + 1) % 3}") & F.col(f"open{(m + 2) % 3}"), enums.OPEN_EDGE).otherwise(F.col(f"adj{m}")).cast("long").alias(f"adj{m}") for m in range(3)]
    return out.select("tri", *marked)


def area(triangles: DataFrame, geographic: bool = False, mode: str = "reference") -> DataFrame:
    """(tri, area) of triangles with corners; in square metres of degrees if geographic."""
    if not geographic:
        return triangles.select("tri", (F.abs("det") / 2.0).alias("area"))
    x, y = [], []
    for i in range(3):
        per_x, per_y = degrees_per_metre(f"y{i}", mode)
        x.append(F.col(f"x{i}") / per_x)
        y.append(F.col(f"y{i}") / per_y)
    return triangles.select("tri", (F.abs((x[0] - x[2]) * (y[1] - y[2]) - (x[1] - x[2]) * (y[0] - y[2])) / 2.0).alias("area"))


def is_geographic(node: DataFrame) -> DataFrame:
    return node.agg((F.max("x") - F.min("x") < 360).alias("is_geographic"))


def across_180(node: DataFrame) -> DataFrame:
    """Longitudes in one piece: 360 more where negative, if they span over 180 degrees."""
    span = node.agg((F.max("x") - F.min("x")).alias("_span"))  # one row
    return node.join(F.broadcast(span), F.lit(True)).withColumn("x", F.when((F.col("_span") > 180) & (F.col("x") < 0), F.col("x") + 360).otherwise(F.col("x"))).drop("_span")


def overlap(outer: DataFrame, inner_located: DataFrame) -> DataFrame:
    """Outer triangles (tri, n0..n2) with at least one node among those located in the inner mesh (column node)."""
    corner = outer.select("tri", F.explode(F.array("n0", "n1", "n2")).alias("node"))
    return corner.join(inner_located.select("node"), "node", "left_semi").select("tri").distinct()


def transform(triangles: DataFrame) -> DataFrame:
    """Rows of the 2 x 2 inverse and the origin that give barycentric coordinates."""
    e = F.expr
    return triangles.select("tri", e("(y1-y2)/det").alias("t00"), e("(x2-x1)/det").alias("t01"), e("(y2-y0)/det").alias("t10"), e("(x0-x2)/det").alias("t11"), F.col("x2").alias("rx"), F.col("y2").alias("ry"))


def barycentric(x: Column, y: Column) -> list[Column]:
    """b0, b1, b2 from the columns of transform()."""
    b0 = F.col("t00") * (x - F.col("rx")) + F.col("t01") * (y - F.col("ry"))
    b1 = F.col("t10") * (x - F.col("rx")) + F.col("t11") * (y - F.col("ry"))
    return [b0.alias("b0"), b1.alias("b1"), (1 - b0 - b1).alias("b2")]
