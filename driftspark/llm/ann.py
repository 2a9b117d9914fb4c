"""Approximate nearest neighbours by cosine: NN-descent builds a graph, queries walk it greedily.

Nodes are distinct vectors (equal vectors share a node that keeps its k + 1 smallest ids, which is all that a
top k can show).  The graph holds, for every node, its ``degree`` best neighbours known.

Start.  In each of ``trees`` random projections the nodes are ranged by the signs of some hyperplanes and by
one projection, cut into blocks of ``BLOCK`` in that order, and compared within blocks.  Ranges follow the
data, so a crowd of near copies is cut like anything else.

Descent.  In each of ``rounds`` joins, every node brings together its neighbours and the nodes that have it as
a neighbour (``reverse`` of them at most, the nearest ones, as NN-descent samples them), with their vectors.
Pairs of which at least one is new are compared, and each node's list is merged with what was found for it.

Search.  A query starts at its own node.  Each step joins the unexpanded nodes of its best ``ef`` to the
graph, whose rows carry the neighbours' vectors, and keeps the best ``ef`` again, until nothing is left to
expand (a node is expanded once, so that comes).  All of them are scored anew on the original vectors in double precision.

Inside, unit vectors are kept as four-byte floats, and compared by -|a - b|^2 / 2, the cosine less one, summed in
double precision: small differences within a crowd of near copies keep their digits.  Recall is measured in the tests and stated in the README.

Edge cases.  Null ids, null, empty or zero vectors and vectors with null or non-finite components take no
part.  Vectors of different lengths are never compared.  Ties go to smaller ids.  A query never returns its
own id; fewer candidates give fewer rows.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import Scratch, groups, map_arrow
from driftspark.llm.vectors import matrix, valid

BLOCK = 256
PLANES = 10
SEED = 7
#: Less than any similarity.
NONE = -9.0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows are first scaled by their largest component, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of a with the rows of b, in double precision, on the vectors as they are unless squares overflow."""
    if max(np.abs(a).max(), np.abs(b).max()) > 1e140 or min(np.abs(a).max(), np.abs(b).max(axis=1).min()) < 1e-140:
        a, b = a / np.abs(a).max(), b / np.abs(b).max(axis=1, keepdims=True)
    return (b @ a) / (np.sqrt(a @ a) * np.sqrt((b * b).sum(axis=1)))


def small(x: np.ndarray) -> np.ndarray:
    """Unit vectors as they are kept."""
    return x.astype("<f4")


def wide(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f4").reshape(-1, dim).astype(np.float64)


def alike(x: np.ndarray) -> np.ndarray:
    """-|a - b|^2 / 2 of all pairs of rows, NONE of a row with itself."""
    half = (x * x).sum(axis=1) / 2
    sim = x @ x.T - half[:, None] - half[None, :]
    np.fill_diagonal(sim, NONE)
    return sim


def _bytes(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _start_keys(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, nodes = batch.column("dim").to_numpy(), batch.column("node").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = wide(_bytes(batch.column("bytes").take(pa.array(at))), dim)
                for tree in range(trees):
                    planes = np.random.default_rng([SEED, tree, dim]).standard_normal((dim, PLANES + 1)).astype(np.float32)
                    side = x @ planes
                    code = ((side[:, :PLANES] > 0) << np.arange(PLANES)).sum(axis=1)
                    yield pa.record_batch(
                        [pa.array(np.full(len(at), tree, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(code.astype(np.int64)),
                         pa.array(side[:, PLANES].astype(np.float64)), pa.array(nodes[at]), batch.column("bytes").take(pa.array(at))],
                        ["tree", "dim", "code", "place", "node", "bytes"],
                    )

    return run


def _pairs(nodes: list, others: list, sims: list) -> pa.RecordBatch:
    cols = [np.concatenate(c) if c else np.empty(0) for c in (nodes, others, sims)]
    return pa.record_batch([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float32))], ["node", "nbr", "sim"])


def _blocks(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, dim, node = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("tree", "dim", "node"))
            raw = batch.column("bytes")
            cuts = np.concatenate([[0], np.flatnonzero((tree[1:] != tree[:-1]) | (dim[1:] != dim[:-1])) + 1, [len(node)]])
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                n = max(1, round((b - a) / BLOCK))
                edges = np.linspace(a, b, n + 1).astype(int).tolist()
                for i, j in zip(edges, edges[1:]):
                    if j - i < 2:
                        continue
                    x = wide(_bytes(raw.slice(i, j - i)), int(dim[i]))
                    sim = alike(x)
                    k = min(degree, j - i - 1)
                    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                    out[0].append(np.repeat(node[i:j], k))
                    out[1].append(node[i:j][best].ravel())
                    out[2].append(np.take_along_axis(sim, best, 1).ravel())
            yield _pairs(*out)

    return run


def _best(degree: int):
    """The best neighbours of each node from rows sorted by node, nbr, old first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["node"]):
            node, nbr, sim, old = (table[n].to_numpy() for n in ("node", "nbr", "sim", "old"))
            first = np.ones(len(node), bool)
            first[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
            node, nbr, sim, old = node[first], nbr[first], sim[first], old[first]
            # groups come whole, one after the other
            order = np.lexsort((nbr, -sim, np.cumsum(np.append(0, node[1:] != node[:-1]))))
            node, nbr, sim, old = node[order], nbr[order], sim[order], old[order]
            starts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
            sizes = np.diff(np.concatenate([starts, [len(node)]]))
            rank = np.arange(len(node)) - np.repeat(starts, sizes)
            last = starts + np.minimum(sizes, degree) - 1
            kth = np.where(sizes >= degree, sim[last], NONE).astype(np.float32)
            kth = np.repeat(kth, sizes)
            keep = rank < degree
            yield pa.record_batch([pa.array(c[keep]) for c in (node, nbr, sim, old, kth)], ["node", "nbr", "sim", "old", "kth"])

    return run


STATE = "node long, nbr long, sim float, old boolean, kth float"


def _merge(rows: DataFrame, degree: int, scratch: Scratch) -> DataFrame:
    rows = rows.repartition("node").sortWithinPartitions("node", "nbr", F.desc("old"))
    return scratch.put(map_arrow(rows, _best(degree), STATE))


def _members(state: DataFrame, nodes: DataFrame, reverse: int) -> DataFrame:
    """(center, member, old, bytes, dim, kth): each node's neighbours, and the nearest of those it is a neighbour of."""
    order = Window.partitionBy("center").orderBy(F.desc("sim"), "member")
    back = state.select(F.col("nbr").alias("center"), F.col("node").alias("member"), "old", "sim")
    back = back.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= reverse).drop("nth", "sim")
    both = state.select(F.col("node").alias("center"), F.col("nbr").alias("member"), "old").union(back)
    both = both.groupBy("center", "member").agg(F.min("old").alias("old"))
    kth = state.groupBy("node").agg(F.max("kth").alias("kth"))
    known = nodes.select("node", "dim", "bytes").join(kth, "node", "left").withColumnRenamed("node", "member")
    return both.join(known, "member").select("center", "member", "old", "bytes", "dim", F.coalesce("kth", F.lit(NONE).cast("float")).alias("kth"))


def _descend(each: int):
    """Pairs among a center's members that improve a member's list; the best few per member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["center"]):
            center, member, kth = (table[n].to_numpy() for n in ("center", "member", "kth"))
            fresh, dim = ~table["old"].to_numpy(), table["dim"].to_numpy()
            raw = _bytes(table["bytes"].combine_chunks() if isinstance(table["bytes"], pa.ChunkedArray) else table["bytes"])
            cuts = np.concatenate([[0], np.flatnonzero(center[1:] != center[:-1]) + 1, [len(center)]])
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                x = wide(raw[a:b], int(dim[a]))
                sim = alike(x)
                sim[~(fresh[a:b, None] | fresh[None, a:b])] = NONE
                k = min(each, b - a - 1)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(sim, best, 1)
                i, j = np.nonzero(got > np.maximum(kth[a:b, None], NONE / 2))
                out[0].append(member[a:b][i])
                out[1].append(member[a:b][best[i, j]])
                out[2].append(got[i, j])
            yield _pairs(*out)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node: its neighbours' ids and vectors."""
    for table in groups(batches, ["center"]):
        center, member = table["center"].to_numpy(), table["member"].to_numpy()
        raw = _bytes(table["bytes"].combine_chunks() if isinstance(table["bytes"], pa.ChunkedArray) else table["bytes"])
        cuts = np.concatenate([[0], np.flatnonzero(center[1:] != center[:-1]) + 1, [len(center)]]).tolist()
        rows = [(int(center[a]), member[a:b].astype("<i8").tobytes(), b"".join(raw[a:b])) for a, b in zip(cuts, cuts[1:])]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["at", "ids", "vectors"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of a query to the neighbours of an expanded node."""
    for batch in batches:
        q, bytes_, ids, vectors = (batch.column(batch.schema.get_field_index(n)) for n in ("q", "bytes", "ids", "vectors"))
        sims = []
        for i in range(batch.num_rows):
            own = bytes_[i].as_buffer().to_pybytes()
            apart = wide([vectors[i].as_buffer().to_pybytes()], len(own) // 4) - wide([own], len(own) // 4)
            sims.append((-(apart * apart).sum(axis=1) / 2).astype("<f4").tobytes())
        yield pa.record_batch([q, ids, pa.array(sims, pa.binary()), pa.array([False] * len(sims))], ["q", "ids", "sims", "pool"])


POOL = "q long, ids binary, sims binary, done binary, next array<bigint>"


def _pools(ef: int):
    """The best ef of a query's pool and what was compared; next: those not expanded yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["q"]):
            q = table["q"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1, [len(q)]]).tolist()
            ids, sims, done = (table[n].combine_chunks() if isinstance(table[n], pa.ChunkedArray) else table[n] for n in ("ids", "sims", "done"))
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                i = np.frombuffer(b"".join(_bytes(ids[a:b])), "<i8")
                s = np.frombuffer(b"".join(_bytes(sims[a:b])), "<f4")
                d = np.concatenate([np.frombuffer(done[r].as_buffer(), bool) if done[r].is_valid else np.zeros(len(ids[r].as_buffer()) // 8, bool) for r in range(a, b)])
                order = np.lexsort((~d, i))  # of equal ids the expanded one first
                i, s, d = i[order], s[order], d[order]
                first = np.ones(len(i), bool)
                first[1:] = i[1:] != i[:-1]
                i, s, d = i[first], s[first], d[first]
                top = np.lexsort((i, -s))[:ef]
                i, s, d = i[top], s[top], d[top]
                rows.append((int(q[a]), i.tobytes(), s.tobytes(), np.ones(len(i), bool).tobytes(), i[~d].tolist()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["q", "ids", "sims", "done", "next"])

    return run


def graph(nodes: DataFrame, scratch: Scratch, degree: int = 24, reverse: int = 24, trees: int = 4, rounds: int = 4, each: int = 8) -> DataFrame:
    """(node, nbr, sim, old, kth): the neighbour graph of nodes (node, dim, bytes)."""
    keys = map_arrow(nodes.select("node", "dim", "bytes"), _start_keys(trees), "tree int, dim int, code long, place double, node long, bytes binary")
    keys = keys.repartitionByRange("tree", "dim", "code", "place").sortWithinPartitions("tree", "dim", "code", "place")
    found = map_arrow(keys, _blocks(degree), "node long, nbr long, sim float")
    state = _merge(found.withColumn("old", F.lit(False)), degree, scratch)
    for _ in range(rounds):
        members = _members(state, nodes, reverse).repartition("center").sortWithinPartitions("center")
        found = map_arrow(members, _descend(each), "node long, nbr long, sim float").withColumn("old", F.lit(False))
        before = state.select("node", "nbr", "sim", F.lit(True).alias("old"))
        after = _merge(before.union(found), degree, scratch)
        scratch.drop(state)
        state = after
    return state


def _node_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        raw: list[bytes | None] = [None] * len(dims)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            for i, x in zip(at.tolist(), small(unit(matrix(batch.column("v").take(pa.array(at)), dim)))):
                raw[i] = x.tobytes()
        yield batch.append_column("bytes", pa.array(raw, pa.binary()))


def _exact(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for i in range(batch.num_rows):
                a = matrix(get["qv"].slice(i, 1), len(get["qv"][i]))[0]
                b = matrix(get["v"].slice(i, 1), len(get["v"][i]))
                score = float(cosine(a, b)[0])
                query = get["query_id"][i].as_py()
                out += [(query, x, score) for x in get["ids"][i].as_py() if x != query][:k]
            cols = zip(*out) if out else ([], [], [])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x.as_buffer(), "<i8").tolist() for x in batch.column("ids")]
        yield pa.record_batch([batch.column("q"), pa.array(ids, pa.list_(pa.int64()))], ["q", "node"])


#: Nodes up to which the pools and rounds as they are have been measured.
MEASURED = 50_000


def grown(nodes: int, ef: int = 256, rounds: int = 4) -> tuple[int, int]:
    """The pool's size and the rounds of descent for so many nodes: a quarter more and half a round for each doubling beyond those measured."""
    doublings = max(0.0, math.log2(max(1, nodes) / MEASURED))
    return math.ceil(ef * (1 + doublings / 4)), rounds + math.ceil(doublings / 2)


def nearest(embeddings: DataFrame, every: int, k: int, ef: int | None = None, **how) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by every.

    ef: the pool's size; by the number of nodes if not given.  how: degree, reverse, trees, rounds and each of graph().
    """
    scratch = Scratch(embeddings.sparkSession, "ann")
    rows = valid(embeddings).where("exists(v, x -> x <> 0)")
    # of equal vectors the smallest ids: the ranking cuts before it shuffles
    first = Window.partitionBy("v").orderBy("vec_id")
    classes = rows.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    classes = classes.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = classes.select(F.xxhash64("v", F.col("ids")[0]).alias("node"), F.size("v").alias("dim"), "ids", "v")
    nodes = scratch.put(map_arrow(classes, _node_bytes, "node long, dim int, ids array<bigint>, v array<double>, bytes binary"))
    by_count = grown(nodes.count())
    ef, how = ef or by_count[0], {"rounds": by_count[1]} | how
    state = graph(nodes, scratch, **how)
    members = _members(state, nodes, how.get("reverse", 24)).repartition("center").sortWithinPartitions("center")
    index = scratch.put(map_arrow(members, _packed, "at long, ids binary, vectors binary"))
    queries = rows.where(F.col("vec_id") % every == 0).distinct().join(nodes.select("v", "node", "bytes"), "v")
    queries = scratch.put(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("node").alias("q"), "bytes"))
    asked = queries.select("q", "bytes").distinct()
    same = F.lit(bytearray(np.float32(0).tobytes()))
    # a node's number as eight little-endian bytes
    own = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("q", 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)]))
    pools = scratch.put(asked.select("q", own.alias("ids"), same.alias("sims"), F.lit(bytearray(b"\1")).alias("done"), F.array("q").alias("next")))
    while not pools.where(F.size("next") > 0).isEmpty():
        ahead = pools.select("q", F.explode("next").alias("at")).join(asked, "q").join(index, "at")
        found = map_arrow(ahead.select("q", "bytes", "ids", "vectors"), _compare, "q long, ids binary, sims binary, pool boolean")
        merged = pools.select("q", "ids", "sims", "done").union(found.select("q", "ids", "sims", F.lit(None).cast("binary").alias("done")))
        after = scratch.put(map_arrow(merged.repartition("q").sortWithinPartitions("q"), _pools(ef), POOL))
        scratch.drop(pools)
        pools = after
    best = map_arrow(pools.select("q", "ids"), _ids, "q long, node array<bigint>")
    pairs = best.select("q", F.explode("node").alias("node")).join(nodes.select("node", "v", "ids"), "node").join(queries.select("query_id", "q", "qv"), "q")
    scored = map_arrow(pairs.select("query_id", "qv", "v", "ids"), _exact(k), "query_id long, vec_id long, score double")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
