"""Best-fit packing of token sequences under several capacities.

A document's ids are cut into pieces of at most ``size`` (only longer ones are cut; the first piece takes
what is left over).  A piece of n tokens asks (n, 1, n * n) of a sequence's capacities: tokens, documents and
attention cost.  Pieces are taken by falling length; each goes to the sequence whose residual capacities
leave the least weighted squared norm after it (``how="norm"``) or have the largest weighted dot product with
what it asks (``how="dot"``), among those that hold it under every capacity; if none does, a new one opens.

Scale.  What a piece asks depends on its length alone, so the plan is made from the counts by length: at most
``size`` numbers reach the driver, whatever the number of documents, and whole groups of alike sequences are
filled at once.  The plan is a list of runs (length, first rank, sequence, offset); each piece finds its place
by its rank among pieces of its length.  Ranks come from row numbers in (length, bucket) groups and the
buckets' running counts, so that a length that a third of all rows share is spread over all buckets.

Tokens.  ids are those of the vocabulary's ``tokenizers`` file.  For texts of code points below 0x250 the same
vocabulary's ranks are used through ``tiktoken``, which is several times faster and gives the same ids (the
tests compare them, each code point included); all other texts, and those that hold a special token's string,
go through ``tokenizers``, long ones in parts that end before a lone blank, where the vocabulary's words end too.

Memory.  A worker process has one encoder, whatever the number of its tasks, and loads the slow tokenizer only when
a text needs it.  Pieces leave a task in batches of ``BATCH_ROWS``.

The query's capacities of documents (1,024) and of attention (1,024 squared) never bind beside 1,024 tokens; smaller
ones do (``documents=``, ``attention=``).

Edge cases.  Null or empty text: the end id alone.  A null doc_id is kept.  Repeated rows are packed as
documents of their own.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import Scratch, map_arrow, own_columns

END_ID = 2
#: Pieces of one length that are numbered in one group, about.
BUCKET_ROWS = 10_000
#: Rows of a batch that leaves a task.
BATCH_ROWS = 2_000
#: Characters that the slow tokenizer gets at once, about.
SLOW_CHARS = 20_000
_USUAL = re.compile(r"[\x00-ɏ]*\Z")
_LONE_BLANK = re.compile(r"(?<=\S)[ \n](?=\S)")


class Encoder:
    """Ids of a byte-level BPE vocabulary: by its ranks where that is known to be the same, else by its file.

    special: the strings of its special tokens; read from the file if not given.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, special: tuple[str, ...] | None = None):
        self.path, self._slow, self.fast = path, None, None
        special = special_tokens(path) if special is None else special
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and _USUAL.match(text) and not (self.special and self.special.search(text)):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        parts = [np.asarray(self.slow.encode(part, add_special_tokens=False).ids, np.uint32) for part in slow_parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def special_tokens(path: str) -> tuple[str, ...]:
    """The strings of a tokenizer file's special tokens."""
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens", []))


def slow_parts(text: str, size: int = SLOW_CHARS) -> list[str]:
    """Parts of about size characters, cut before a lone blank between other signs: a word of the pattern begins there."""
    out, at = [], 0
    while len(text) - at > size and (found := _LONE_BLANK.search(text, at + size)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


@lru_cache(maxsize=1)
def _encoder(args: tuple) -> Encoder:
    """The worker process's encoder."""
    return Encoder(*args)


def cuts(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes the rest."""
    first = length % size or size
    return [(0, first), *((a, size) for a in range(first, length, size))] if length > size else [(0, length)]


def _pieces(encoder: tuple, size: int, end_id: int, keep_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = _encoder(encoder)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (a, n) in enumerate(cuts(len(ids), size)):
                    part = ids[a : a + n]
                    yield (doc.as_py(), k, a, n, zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(rows_of(batches), BATCH_ROWS):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def pieces(docs: DataFrame, encoder: tuple, size: int = 1024, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if they are kept.

    encoder: the arguments of Encoder; paths must be readable on the executors.
    """
    if len(encoder) < 4:  # read here, so that no worker has to parse the file
        encoder = (*encoder, *[None] * (3 - len(encoder)), special_tokens(encoder[0]))
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_arrow(docs, _pieces(encoder, size, end_id, keep_ids), schema)


@dataclass
class Bins:
    """Alike sequences: how many, what each has left, and runs (length, first rank, pieces each, offset)."""

    n: int
    left: tuple[int, int, int]
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> Bins:
        """Takes the first n away."""
        first = Bins(n, self.left, list(self.runs))
        self.runs = [(length, low + n * each, each, offset) for length, low, each, offset in self.runs]
        self.n -= n
        return first

    def put(self, size: int, low: int, each: int, length: int) -> None:
        self.runs.append((length, low, each, size - self.left[0]))
        self.left = (self.left[0] - each * length, self.left[1] - each, self.left[2] - each * length * length)


def plan(counts: dict[int, int], size: int = 1024, documents: int | None = None, attention: int | None = None, how: str = "norm", weights=(1.0, 1.0, 1.0)) -> list[Bins]:
    """Sequences for so many pieces of each length."""
    full = (size, documents or size, attention or size * size)
    if any(not 0 < n <= size or n * n > full[2] for n in counts):
        raise ValueError("a piece is larger than a sequence's capacities")
    done, opened = [], []
    smallest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        count, rank = counts[length], 0
        asks = (length, 1, length * length)
        fits = lambda b: all(x >= y for x, y in zip(b.left, asks))  # noqa: E731, B023

        def worth(b: Bins) -> float:
            if how == "dot":
                return sum(w * x * y / (c * c) for w, x, y, c in zip(weights, b.left, asks, full))  # noqa: B023
            return -sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, b.left, asks, full))  # noqa: B023

        def fill(group: Bins, count: int, rank: int) -> tuple[int, list[Bins]]:
            """Puts pieces of this length into sequences of a group, each as full as it gets; how many, and the groups then."""
            each = min(x // y for x, y in zip(group.left, asks))  # noqa: B023
            made, used = [], 0
            if whole := min(group.n, count // each):
                part = group.split(whole)
                part.put(size, rank, each, length)  # noqa: B023
                made.append(part)
                used = whole * each
            if group.n and used < count < used + each:
                part = group.split(1)
                part.put(size, rank + used, count - used, length)  # noqa: B023
                made.append(part)
                used = count
            return used, made + [group] * (group.n > 0)

        while count:
            able = [b for b in opened if fits(b)]
            if able:
                group = max(able, key=worth)
                opened.remove(group)
            else:
                group = Bins(count, full)
            used, made = fill(group, count, rank)
            if not able:
                made = [b for b in made if b.runs]
            count, rank = count - used, rank + used
            for b in made:
                (opened if b.left[0] >= smallest and b.left[1] and b.left[2] >= smallest * smallest else done).append(b)
    return done + opened


def _places(bins: list[Bins]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, sequence, pieces each, offset) by rank."""
    out: dict[int, list] = {}
    sequence = 0
    for b in bins:
        for length, low, each, offset in b.runs:
            out.setdefault(length, []).append((low, sequence, each, offset))
        sequence += b.n
    return {k: np.array(sorted(v), np.int64) for k, v in out.items()}


def _assign(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = broadcast.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                table = places[n]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * n
            batch = batch.drop_columns(["rank"])
            for name, values in (("sequence_id", sequence), ("offset", offset)):
                batch = batch.append_column(name, pa.array(values))
            yield batch

    return run


def pack(made: DataFrame, size: int = 1024, **how) -> DataFrame:
    """The pieces with sequence_id and offset.  made: a table of pieces() that is cheap to read again."""
    spark = made.sparkSession
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    buckets = max(1, total // BUCKET_ROWS) if total < BUCKET_ROWS * 100_000 else 100_000
    places = spark.sparkContext.broadcast(_places(plan(counts, size, **how)))
    numbered = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by = Window.partitionBy("length", "bucket")
    numbered = numbered.withColumn("nth", F.row_number().over(by.orderBy("doc_id", "piece", "start", "ids_crc32")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = made.select("length", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).alias("bucket"))
    sizes = sizes.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = numbered.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    ranked = ranked.select(*made.columns, F.col("rank").cast("long"))
    return map_arrow(ranked, _assign(places), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, encoder: tuple, size: int = 1024, end_id: int = END_ID, keep_ids: bool = False, **how) -> DataFrame:
    """Documents to packed pieces; the pieces are kept as a shared table between tokenizing and packing."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.put(pieces(docs, encoder, size, end_id, keep_ids)), size, **how)
