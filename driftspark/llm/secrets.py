"""Secret scans with multipart credential linking.

Base spans, leftmost and non-overlapping per kind: ``assign`` (a password, secret, token or key given a value
of six or more characters), ``access`` (AKIA identifiers of 20 or more characters), ``hex`` (24 or more hex
digits).  They are always reported.

Weak candidates say little alone: ``weak_access`` (16 to 40 capitals and digits, both present),
``weak_secret`` (24 or more base64 characters of mixed case with digits and an entropy of 3.5 bits or more) and
``endpoint`` (a URL).  They are linked by an interval join: each part's scope is its span widened by
``reach`` code points, cut at blank lines.  A weak access identifier is reported if a secret part (assign,
hex, weak secret) overlaps its scope; a weak secret if an access identifier does; an endpoint if both an
access identifier and a secret part do.  Parts of one scope are ordered by their start, so the join is a
bisection of sorted intervals within each document.

Whole texts are read; a document's spans are all that is held.  Spans are in code points, end exclusive.
Edge cases.  Null text: empty, no spans.  Repeated rows each get their row.  A null doc_id is kept.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import column_of, map_arrow, own_columns

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_access", "weak_secret", "endpoint")

# re.A with re.I: only A-Z and a-z fold, not the long s or the Kelvin sign
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{16,40}(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+")
BLANK = re.compile(r"\n[ \t\r]*\n")

REACH = 200
LEAST_ENTROPY = 3.5


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then in the order of BASE."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    # a run of 20 or more is the base form's maximal run that passes, so nothing else needs to be looked at
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def weak_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Weak candidates that complementary parts stand beside."""
    weak = [(m.start(), m.end(), "weak_access") for m in WEAK_ACCESS.finditer(text)]
    weak += [
        (m.start(), m.end(), "weak_secret")
        for m in WEAK_SECRET.finditer(text)
        if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and entropy(m[0]) >= LEAST_ENTROPY
    ]
    weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if base or weak else []
    taken = sorted((a, b) for a, b, _ in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def covered(a: int, b: int) -> bool:
        """Whether a base span says some of it already."""
        i = bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    weak = [x for x in weak if x[2] == "endpoint" or not covered(x[0], x[1])]
    if not weak:
        return []
    walls = [m.start() for m in BLANK.finditer(text)]
    access = sorted(x[:2] for x in (*base, *weak) if x[2] in ("access", "weak_access"))
    secret = sorted(x[:2] for x in (*base, *weak) if x[2] in ("assign", "hex", "weak_secret"))

    def furthest(parts: list[tuple[int, int]]) -> list[int]:
        return list(accumulate((b for _, b in parts), max))

    reached = {id(parts): furthest(parts) for parts in (access, secret)}

    def near(parts: list[tuple[int, int]], span: tuple[int, int, str]) -> bool:
        """Whether a part other than the span itself overlaps the span's scope."""
        a, b, _ = span
        i, j = bisect_left(walls, a), bisect_left(walls, b)
        low, high = max(a - reach, walls[i - 1] if i else 0), min(b + reach, walls[j] if j < len(walls) else len(text))
        k = bisect_left(parts, (high, 0))
        while k and reached[id(parts)][k - 1] > low:
            k -= 1
            if parts[k] != (a, b) and parts[k][1] > low:
                return True
        return False

    def kept(x: tuple[int, int, str]) -> bool:
        if x[2] == "weak_access":
            return near(secret, x)
        return near(access, x) and (x[2] != "endpoint" or near(secret, x))

    return [x for x in weak if kept(x)]


def scan(text: str, reach: int = REACH) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then in the order of KINDS."""
    base = base_spans(text)
    return sorted([*base, *weak_spans(text, base, reach)], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t.as_py() or "", reach)] for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans) of every row; spans an array of kind, start, end."""
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(docs, _scan(reach), f"doc_id long, spans {SPANS}")


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            spans = [(x["start"], x["end"], x["kind"]) for x in spans]
            base = [x for x in spans if x[2] in BASE]
            out.append([sum(x[2] == k for x in base) for k in BASE] + [hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)])
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, for each row of find_secrets()."""
    return map_arrow(found, _digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping secret spans replaced by [SECRET]; endpoints stay."""
    out, at = [], 0
    for a, b, kind in spans:
        if kind == "endpoint":
            continue
        if a >= at:
            out.append(text[at:a])
            out.append("[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def _mask(reach: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = [mask(t, scan(t, reach)) if t is not None else None for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def mask_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The documents with their secrets masked; all rows and columns of the input, n_chars as it now is."""
    own_columns(docs, "text")
    text = column_of(docs, "text")
    out = map_arrow(docs, _mask(reach, text), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(f"`{text}`").cast(docs.schema["n_chars"].dataType))
    return out
