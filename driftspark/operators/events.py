"""Windows over each particle's states in time: edges, visits, distances, forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("t", "event_id")


def by_particle(*order: str):
    return Window.partitionBy("id").orderBy(*(order or ORDER))


def edges(obs: DataFrame, inside: Column) -> DataFrame:
    """States at which a condition begins (+1) or ends (-1) to hold."""
    rows = obs.withColumn("ins", F.when(inside, 1).otherwise(0))
    rows = rows.withColumn("before", F.coalesce(F.lag("ins").over(by_particle()), F.lit(0))).where("ins <> before")
    return rows.withColumn("flag", F.when(F.col("ins") == 1, 1).otherwise(-1).cast("long"))


def entry_exit(obs: DataFrame, polygon: Column) -> DataFrame:
    """Entries and exits with the polygon of entry; moving from one polygon to another without a gap is no event."""
    rows = obs.withColumn("poly", polygon).withColumn("ins", F.col("poly") >= 0)
    rows = rows.withColumn("before", F.coalesce(F.lag("ins").over(by_particle()), F.lit(False)))
    entered = F.last(F.when(F.col("ins") & ~F.col("before"), F.col("poly")), ignorenulls=True).over(by_particle())
    rows = rows.withColumn("event_poly", entered).where("ins <> before")
    return rows.withColumn("flag", F.when(F.col("ins"), 1).otherwise(-1).cast("long"))


def residence(obs: DataFrame, inside: Column, *keys: str) -> DataFrame:
    """States inside (exposure), and those of the first visit (residence), by keys."""
    rows = obs.withColumn("ins", F.when(inside, 1).otherwise(0))
    enters = F.when((F.col("ins") == 1) & (F.coalesce(F.lag("ins").over(by_particle()), F.lit(0)) == 0), 1).otherwise(0)
    visit = F.sum("ent").over(by_particle().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ent", enters).withColumn("visit", visit)
    first = F.when((F.col("ins") == 1) & (F.col("visit") == 1), 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("ins").alias("exposure"), F.sum(first).alias("residence"))


def distance(obs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Running horizontal distance."""
    dx, dy = (F.col(v) - F.lag(v).over(by_particle()) for v in (x, y))
    rows = obs.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return rows.withColumn("distance", F.sum("step").over(by_particle().rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def time_at_status(obs: DataFrame, status: int) -> DataFrame:
    """Running time with a status, counted from each state to the next."""
    dt = F.coalesce(F.col("t") - F.lag("t").over(by_particle()), F.lit(0))
    rows = obs.withColumn("dt", F.when(F.lag("status").over(by_particle()) == status, dt).otherwise(0))
    return rows.withColumn("time_at", F.sum("dt").over(by_particle().rowsBetween(Window.unboundedPreceding, 0))).drop("dt")


def fill_forward(state: DataFrame, steps: DataFrame, columns: list[str], dead: int = -5) -> DataFrame:
    """A row for each particle and step from its first on; after its last it keeps its values and is dead.

    steps: nt, consecutive.
    """
    span = state.groupBy("id").agg(F.min("nt").alias("a"), F.max("nt").alias("b"))
    last = steps.agg(F.max("nt").alias("z"))
    dense = span.join(F.broadcast(last), F.lit(True)).select("id", "b", F.explode(F.sequence("a", "z")).alias("nt"))
    rows = dense.join(state, ["id", "nt"], "left")
    w = Window.partitionBy("id").orderBy("nt")
    filled = [F.last(v, ignorenulls=True).over(w).alias(v) for v in columns]
    status = F.when(F.col("nt") > F.col("b"), dead).otherwise(F.last("status", ignorenulls=True).over(w)).cast("long")
    return rows.select("id", "nt", *filled, status.alias("status"))
