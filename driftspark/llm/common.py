"""What the corpus operators share: shared scratch tables, code shipping, connected components.

Recovery: nothing here keeps the only copy of a result on an executor.  Lineage is cut with Parquet
tables in the shared folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.session import ship

#: Used where spark.checkpoint.dir is unset, which is so in tests on one machine only.
LOCAL_SCRATCH = "/tmp/checkpoints"

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where the session names none and runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root or f"file://{LOCAL_SCRATCH}"


class Scratch:
    """Parquet tables of one operator call in the shared folder."""

    #: Those that are not closed yet.
    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        Scratch.opened.append(self)

    def close(self) -> None:
        """Deletes all tables; nothing may read them any more."""
        self._delete(self.root)
        Scratch.opened.remove(self)

    def put(self, df: DataFrame) -> DataFrame:
        """Writes df, and gives a DataFrame that reads it back: its lineage ends there."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        # once the table is written, nothing reads the shuffle files that led to it
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN)
            else:
                self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        self._delete(df.scratch_path)

    def _delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[[], DataFrame], scratch: Scratch) -> DataFrame:
    """What make() gives, as a table of scratch; the tables that were made on the way are deleted."""
    others = list(Scratch.opened)
    out = scratch.put(make())
    for made in [s for s in Scratch.opened if s not in others and s is not scratch]:
        made.close()
    return out


def _tidy(function):
    """The function, after which its worker process gives memory back that it doesn't use: the next task may be another's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over a DataFrame, with the package's code on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(function), schema)


def own_columns(df: DataFrame, *names: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Only the named columns, by names without case; an optional one that the input has not is null."""
    have: dict[str, list[str]] = {}
    for c in df.columns:
        have.setdefault(c.lower(), []).append(c)
    out = []
    for n in names:
        found = have.get(n.lower(), [])
        exact = [c for c in found if c == n]
        if len(exact or found) > 1:
            raise ValueError(f"more than one column is called {n}")
        if not found and n not in optional:
            raise ValueError(f"there is no column {n}, but {', '.join(df.columns)}")
        out.append(df[f"`{(exact or found)[0]}`"].alias(n) if found else F.lit(None).alias(n))
    return df.select(*out)


def column_of(df: DataFrame, name: str) -> str:
    """What the input calls a column; names compare without case."""
    return next(c for c in sorted(df.columns, key=lambda c: c != name) if c.lower() == name.lower())


def fresh(base: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken (names compare without case)."""
    low, name = {t.lower() for t in taken}, base
    while name.lower() in low:
        name += "_"
    return name


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by the keys.

    Whole runs of a batch come together in one table; a run is never cut.  Memory: one batch and one run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(max(batch.num_rows - 1, 0), bool)
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            differs |= col[1:] != col[:-1]
        same_as_held = held and all(
            held[-1].column(held[-1].schema.get_field_index(k))[-1] == batch.column(batch.schema.get_field_index(k))[0]
            for k in keys
        )
        cuts = np.flatnonzero(differs) + 1
        if held and not same_as_held:
            yield pa.Table.from_batches(held)
            held = []
        if not len(cuts):
            held.append(batch)
            continue
        if held:
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[0])])
            start = cuts[0]
        else:
            start = 0
        if cuts[-1] > start:
            yield pa.Table.from_batches([batch.slice(start, cuts[-1] - start)])
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (any orderable type, no nulls).  Returns (node, root), root the smallest node that
    node reaches, for every node of an edge between two different nodes.  Each step aggregates a node's
    neighbours to their minimum (map-side first) and joins it back, so that a hub's edges are dealt like
    others' by the skew join; every step ends in a shared table.
    """
    least = F.least("a", "b")
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), least.alias("v")).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = _mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node whose smallest neighbour is larger than itself is its own minimum: its edges stay as they are
        large = scratch.put(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        after = scratch.put(small.where("u <> v").distinct())
        scratch.drop(large)
        scratch.drop(now)
        now, seen = after, mark
        mark = _mark(now)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(df: DataFrame):
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
