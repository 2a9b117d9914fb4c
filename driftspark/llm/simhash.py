"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves.  Two fingerprints that differ in at most three bits differ in
at most one bit of some half, so they share a variant of it: the half with one bit removed, together with
the place of that bit.  Each distinct fingerprint is indexed under 64 such variants (two halves, 32 places).
An equality shuffle on (half, place, remaining 31 bits) brings candidates together, and the whole
fingerprints verify them.  No link is lost and nothing is capped.

Large groups.  Copies collapse first: only distinct fingerprints are indexed.  A bucket gives a spanning
forest of its links, not its pairs: a fingerprint that has been reached leaves the search, so that a dense
bucket costs little more than its size.  Buckets of more than ``chunk`` fingerprints are found by a count
and split in chunks; each pair of chunks is a group of its own, so no task holds more than 2 * chunk.

Edge cases.  Null or wordless text: fingerprint zero, linked like any other.  Fewer than ``width`` words:
one shingle of all the words.  Repeated rows count as documents of their own.  A null doc_id takes part in
links but is never a component_id; a component of null ids only has a null component_id.  An empty table
gives no rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Scratch, components, fresh, groups, map_arrow, own_columns, settled

#: Shingle hashes whose bits are counted at once: 64 bytes each.
BLOCK = 1 << 15
SEED = 42


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, repeats included; ASCII letters lower-cased."""
    words = text.lower().split()  # bytes.split() cuts at \x20 and \x09-\x0D exactly
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                out.append(fingerprint(shingle_hashes(raw, width)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long): the bits of the fingerprint as a signed number."""
    docs = own_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_arrow(docs, _fingerprints(width), "doc_id long, fp long")


def forest(fps: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: pairs (reached from, reached)."""
    left, a, b = fps.copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), x))
                b.append(got)
                queue.extend(got)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "part"]):
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            fps = table["fp"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            many = sizes > 2
            a, b = [], []
            # groups of two, all at once
            i = starts[sizes == 2]
            near = np.bitwise_count(fps[i] ^ fps[i + 1]) <= bits
            a.append(fps[i][near])
            b.append(fps[i + 1][near])
            for at, n in zip(starts[many].tolist(), sizes[many].tolist()):
                x, y = forest(fps[at : at + n], bits)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def links(distinct: DataFrame, bits: int = 3, chunk: int = 100_000) -> DataFrame:
    """(a, b): links among the distinct fingerprints of column fp that join all that are at most bits apart.

    bits: 1 to 3, as two halves share a one-bit variant only up to there.
    """
    if not 1 <= bits <= 3:
        raise ValueError("bits must be 1, 2 or 3")
    half = "(fp >> (32 * (v div 32))) & 4294967295"
    # dealt anew over all cores, as each row becomes 64 and small partitions have been put together
    spread = 2 * distinct.sparkSession.sparkContext.defaultParallelism
    variants = distinct.repartition(spread).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(
        "fp",
        F.expr(f"shiftleft(cast(v as bigint), 32) | (({half}) & ~shiftleft(1L, v % 32))").alias("key"),
    )
    big = variants.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    big = big.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("cut"))
    keyed = variants.join(big, "key", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("cut", F.lit(1))))
    # chunk i meets chunk j in the group of the pair; a bucket in one chunk is one group
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("cut", F.lit(1)) - 1)))
    part = F.least("mine", "other") * 1_000_000 + F.greatest("mine", "other")
    keyed = keyed.select("key", part.cast("long").alias("part"), "fp")
    return map_arrow(keyed.repartition("key", "part").sortWithinPartitions("key", "part"), _links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3, chunk: int = 100_000) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, the smallest doc_id it reaches.

    Membership comes back by a join on the fingerprint, in which a hot fingerprint is split as skew.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, width))
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"), bits, chunk), scratch)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    member = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; all columns of the input.

    Rows with a null doc_id stay.  Of several rows with one doc_id, all stay if the id does.
    """
    name = fresh("_gone_id", docs.columns)
    gone = settled(lambda: near_duplicates(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), Scratch(docs.sparkSession, "gone"))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
