"""Exact top-k by inner product with KD-trees per shard.

Vectors are dealt into shards of about ``shard_rows`` rows by a hash of id and vector.  A shard is cut by medians of
its widest component into a tree with a tight bounding box around each node.  The largest inner product that a box
allows is sum(max(q * low, q * high)); a query goes best-first, from the node of the largest bound to its children,
and stops at the first that cannot beat its kth score (or can only equal it with larger ids).

Propagation.  All queries first search one pilot shard of each dimension.  The kth score found there is a
bound that the true kth score is never below, and goes with each query to the other shards, which then open
fewer leaves and return only what can still matter.

Shape.  Queries come in blocks of ``query_rows``; a task holds one block and one shard.  Every block meets
every shard by an equality join on the shard's number (a stated query set against all rows, in blocks).  The
k best of all shards are merged by a ranking that cuts before it shuffles.

Arithmetic is exact: floor(64 * x) of doubles, then products in doubles while every sum stays below 2**53,
else in Python's integers.  A score outside 64 bits raises an error.

Edge cases.  Null ids, null vectors, and vectors with null or non-finite components take no part.  Vectors of
different lengths are never compared.  Ties go to smaller ids.  Repeated rows are candidates of their own and
take a rank each, but a query never returns its own id; a query id that occurs twice ranks the candidates of all
its rows together, as often as they occur.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import Scratch, groups, map_arrow
from driftspark.llm.vectors import matrix, valid

EXACT = float(1 << 53)
LEAF = 256


class Shard:
    """A KD-tree: median splits along the widest component, a tight box around each node, its children or its rows.

    Rows of a leaf lie together; least: the smallest id below a node.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.children: list[tuple[int, int] | None] = []
        boxes, parts, at = [], [], []
        todo: list[tuple[np.ndarray, int]] = [(np.arange(len(x)), -1)]
        while todo:
            rows, parent = todo.pop()
            node, part = len(self.children), x[rows]
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            self.children.append(None)
            boxes.append((part.min(0), part.max(0), ids[rows].min()))
            if len(rows) <= leaf or x.shape[1] == 0:
                at.append((sum(map(len, parts)), len(rows)))
                parts.append(rows)
                continue
            at.append((0, 0))
            axis = int(np.argmax(part.max(0) - part.min(0)))
            order = np.argpartition(part[:, axis], len(rows) // 2)
            todo += [(rows[order[: len(rows) // 2]], node), (rows[order[len(rows) // 2 :]], node)]
        order = np.concatenate(parts)
        self.ids, self.x, self.at = ids[order], x[order], at
        self.low, self.high = (np.array([b[n] for b in boxes]) for n in (0, 1))
        self.least = [int(b[2]) for b in boxes]

    def search(self, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        """For each query the ids and scores of at most k candidates that can still be among its k best.

        kth: scores that the true kth score isn't below.
        """
        bounds = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        for row in range(len(q)):
            best_ids, best = np.empty(0, np.int64), np.empty(0)
            floor, own = kth[row], bounds[row].tolist()
            heap = [(-own[0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                bound = -bound
                if bound < floor:
                    break
                if len(best) == k and bound == best[-1] and self.least[node] > best_ids[-1]:
                    continue
                if self.children[node]:
                    for child in self.children[node]:
                        if own[child] >= floor:
                            heapq.heappush(heap, (-own[child], child))
                    continue
                start, size = self.at[node]
                rows = slice(start, start + size)
                score = self.x[rows] @ q[row]
                near = (score >= floor) & (self.ids[rows] != ids[row])
                if not near.any():
                    continue
                all_ids, all_scores = np.concatenate([best_ids, self.ids[rows][near]]), np.concatenate([best, score[near]])
                top = np.lexsort((all_ids, -all_scores))[:k]
                best_ids, best = all_ids[top], all_scores[top]
                if len(best) == k:
                    floor = max(floor, best[-1])
            yield best_ids, best


def _floor64(x: np.ndarray) -> np.ndarray:
    return np.floor(64 * x)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: E731, B023
                dim = get("dim").as_py()
                key = (dim, get("shard").as_py())
                if key != at:
                    ids = np.frombuffer(get("ids").as_buffer(), np.int64)
                    shard, at = Shard(ids, np.frombuffer(get("data").as_buffer()).reshape(len(ids), dim)), key
                ids = np.frombuffer(get("q_ids").as_buffer(), np.int64)
                q = np.frombuffer(get("q_data").as_buffer()).reshape(len(ids), dim)
                rows = np.frombuffer(get("q_rows").as_buffer(), np.int64)
                kth = np.frombuffer(get("kth").as_buffer())
                widest = float(np.abs(shard.x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, dim)
                if widest >= EXACT:
                    found = _in_integers(shard, ids, q, k)
                else:
                    found = shard.search(ids, q, kth, k)
                out = [(np.full(len(a), r), np.full(len(a), i), a, s) for r, i, (a, s) in zip(rows, ids, found)]
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
                yield pa.record_batch([pa.array(c) for c in cols], ["q_row", "query_id", "vec_id", "score"])

    return run


def _in_integers(shard: Shard, ids: np.ndarray, q: np.ndarray, k: int):
    """The k best of all rows in Python's integers, for components too large for doubles."""
    x = [[int(v) for v in row] for row in shard.x]
    for i, row in zip(ids, q):
        y = [int(v) for v in row]
        scored = sorted((-sum(a * b for a, b in zip(v, y)), int(c)) for v, c in zip(x, shard.ids) if c != i)[:k]
        if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in scored):
            raise OverflowError("an inner product doesn't fit 64 bits")
        yield np.array([c for _, c in scored], np.int64), np.array([-s for s, _ in scored], np.int64)


def _packed(kind: str, parts: int, most: int):
    """One row per group (dim, part): ids and data as bytes.  What is over most rows goes to parts of further numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["dim", "part"]):
            keys = np.stack([table["dim"].to_numpy(), table["part"].to_numpy()])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
            spans = [(i, min(i + most, b), (i - a) // most) for a, b in zip(cuts, cuts[1:]) for i in range(a, b, most)]
            for a, b, more in spans:
                part = table.slice(a, b - a)
                dim, ids = int(keys[0, a]), part["vec_id"].to_numpy()
                data = _floor64(matrix(part["v"], dim))
                yield pa.record_batch(
                    [pa.array([dim], pa.int32()), pa.array([keys[1, a] + more * parts], pa.int64()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([np.ascontiguousarray(data).tobytes()])],
                    ["dim", "part", f"{kind}ids", f"{kind}data"],
                )

    return run


def _deal(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Rows packed by parts of about size rows, four times as many at most: dim, part, ids, data.  Needs the count of rows."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)))
    dealt = dealt.repartition(n, "dim", "part").sortWithinPartitions("dim", "part", "vec_id")
    return map_arrow(dealt, _packed(kind, n, 4 * size), f"dim int, part long, {kind}ids binary, {kind}data binary")


def top_k(embeddings: DataFrame, every: int, k: int, shard_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by every."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "topk")
    rows = valid(embeddings)
    shards = scratch.put(_deal(rows, shard_rows, ""))
    blocks = scratch.put(_deal(rows.where(F.col("vec_id") % every == 0), query_rows, "q_"))
    numbers = shards.groupBy("dim").agg(F.min("part").alias("pilot"), F.max("part").alias("last"))
    shards = shards.withColumnRenamed("part", "shard")
    blocks = blocks.join(numbers, "dim")
    schema = "q_row long, query_id long, vec_id long, score long"

    def run(blocks: DataFrame) -> DataFrame:
        pairs = blocks.join(shards, ["dim", "shard"]).sortWithinPartitions("dim", "shard")
        return map_arrow(pairs.select("dim", "shard", "ids", "data", "q_ids", "q_data", "q_rows", "kth"), _search(k), schema)

    first = map_arrow(blocks, _with_kth, "dim int, part long, q_ids binary, q_data binary, q_rows binary, kth binary, pilot long, last long")
    pilot = scratch.put(run(first.withColumn("shard", F.col("pilot"))))
    # the kth scores of the pilot, packed beside the queries of their block
    low = pilot.groupBy("q_row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    low = low.withColumn("dim", F.shiftright("q_row", 48).cast("int")).withColumn("part", F.shiftright("q_row", 20).bitwiseAND((1 << 28) - 1))
    low = low.groupBy("dim", "part").agg(F.collect_list(F.struct("q_row", "kth")).alias("low"))
    again = blocks.join(low, ["dim", "part"], "left").where("last > pilot")
    again = map_arrow(again, _with_kth, "dim int, part long, q_ids binary, q_data binary, q_rows binary, kth binary, pilot long, last long")
    rest = run(again.withColumn("shard", F.explode(F.sequence("pilot", "last"))).where("shard <> pilot"))
    found = pilot.union(rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _with_kth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a block's queries (dim, part and place in 64 bits) and lays out their known kth scores."""
    for batch in batches:
        names = batch.schema.names
        rows_out, kth_out = [], []
        for row in range(batch.num_rows):
            n = len(np.frombuffer(batch.column(names.index("q_ids"))[row].as_buffer(), np.int64))
            base = (batch.column(names.index("dim"))[row].as_py() << 48) | (batch.column(names.index("part"))[row].as_py() << 20)
            numbers = base + np.arange(n)
            kth = np.full(n, -np.inf)
            for x in (batch.column(names.index("low"))[row].as_py() or []) if "low" in names else []:
                kth[x["q_row"] - base] = x["kth"]
            rows_out.append(numbers.astype(np.int64).tobytes())
            kth_out.append(kth.tobytes())
        keep = {n: batch.column(names.index(n)) for n in ("dim", "part", "q_ids", "q_data", "pilot", "last")}
        cols = [keep["dim"], keep["part"], keep["q_ids"], keep["q_data"], pa.array(rows_out, pa.binary()), pa.array(kth_out, pa.binary()), keep["pilot"], keep["last"]]
        yield pa.record_batch(cols, ["dim", "part", "q_ids", "q_data", "q_rows", "kth", "pilot", "last"])
