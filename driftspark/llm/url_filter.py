"""URL filters: explicit rules first, then a character language-model ratio, in DataFrame functions only.

Rules name a host (with all subdomains) and the start of a path; the longest that fits decides.  URLs that a
rule decides are the training text: accepted and rejected ones each get a smoothed variable-order Markov
model of characters (Witten-Bell, contexts of 0 to 4 signs), counted over all of them.  Other URLs are judged
by the mean over their characters of the difference of the two models' log-likelihoods, against a threshold.

Calibration.  A tenth of the decided URLs, by a hash of their text, is left out of the counts; the threshold
is the value that gives the least balanced error on them.

Scale.  The counts are made once and kept as a shared table, as are the scores of all distinct URLs that need one.
Only distinct five-sign strings are scored, by joins of count tables of the same kind; the pages'
strings meet those scores in one equality join, whose hot strings are split as skew.  Signs are the printable
ASCII characters and one for all others, so the order-0 table (at most 97 rows) may go through the driver,
and so may the histogram of calibration scores (at most 4,001 rows).  Nothing else does.

Edge cases.  Null url or no ``://``: empty host and path, judged as an empty text.  Equal URLs get equal
verdicts.  Without accepted or without rejected URLs there is no ratio and what no rule decides is allowed.
A null page_id is kept.  Repeated rows each get their row.  Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Scratch, own_columns

#: host, path start, verdict
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 4
START, END, OTHER = "\x01", "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Probability of a sign before anything is known.
FLOOR = 1 / 97
#: Steps of the calibration's histogram, from -SPAN to SPAN.
SPAN, STEPS = 4.0, 2000


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    pages = own_columns(pages, "page_id", "url").withColumn("url", F.col("url").cast("string"))
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.select("page_id", "url", host.alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"), "_rest")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(scored: DataFrame, *keep: str) -> DataFrame:
    """One row per character of column key: the string of ORDER signs before it and itself."""
    folded = F.regexp_replace("key", "[^\\x20-\\x7e]", OTHER)
    padded = F.concat(F.lit(START * ORDER), folded, F.lit(END))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(F.col("_padded"), i, F.lit(ORDER + 1))))
    return scored.withColumn("_padded", padded).select(*keep, gram.alias("gram"))


def _ratio(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio) for distinct grams: log-likelihood of the last sign, accepted minus rejected.

    counts: gram, good, bad.  From order 0 up, p = (n + t * p_shorter) / (N + t), N what followed the
    context, t how many different signs did.
    """
    zero = counts.groupBy(F.right("gram", F.lit(1)).alias("sign")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    out = grams.select("gram")
    for kind in ("good", "bad"):
        total, t = sum(r[kind] for r in zero), sum(r[kind] > 0 for r in zero)
        base = {r.sign: (r[kind] + t * FLOOR) / (total + t) for r in zero}
        lookup = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
        out = out.withColumn(kind, F.coalesce(lookup[F.right("gram", F.lit(1))], F.lit(t * FLOOR / (total + t))))
    for k in range(1, ORDER + 1):
        # every context's followers in one row: as many as there are signs at most
        sums = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("g")).agg(F.sum("good").alias("a"), F.sum("bad").alias("b"))
        entry = F.struct(F.right("g", F.lit(1)).alias("s"), F.struct("a", "b").alias("n"))
        table = sums.groupBy(F.left("g", F.lit(k)).alias("context")).agg(
            F.map_from_entries(F.collect_list(entry)).alias("n"),
            *[F.sum(c).alias(f"n_{c}") for c in "ab"],
            *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in "ab"],
        )
        out = out.withColumn("context", F.left(F.right("gram", F.lit(k + 1)), F.lit(k))).join(table, "context", "left")
        n = F.col("n")[F.right("gram", F.lit(1))]
        for kind, c in (("good", "a"), ("bad", "b")):
            p = (F.coalesce(n[c], F.lit(0)) + F.col(f"t_{c}") * F.col(kind)) / (F.col(f"n_{c}") + F.col(f"t_{c}"))
            out = out.withColumn(kind, F.when(F.col(f"n_{c}") > 0, p).otherwise(F.col(kind)))
        out = out.select("gram", "good", "bad")
    # decimals, so that sums don't depend on the order of addition
    return out.select("gram", (F.ln("good") - F.ln("bad")).cast("decimal(20,12)").alias("ratio"))


def _scores(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, score) for distinct keys: mean ratio over the key's characters."""
    grams = _grams(keys, "key")
    ratio = _ratio(grams.select("gram").distinct(), counts)
    total = grams.join(ratio, "gram").groupBy("key").agg(F.sum("ratio").alias("total"))
    return total.select("key", F.round(F.col("total").cast("double") / (F.length("key") + 1), 9).alias("score"))


def threshold(calibration: list[tuple[int, int, int]]) -> float:
    """From (step, accepted, rejected): the step's lower edge below which to reject, for the least balanced error."""
    good, bad = sum(r[1] for r in calibration), sum(r[2] for r in calibration)
    if not good or not bad:
        return 0.0
    # rejecting what is below an edge: errors are accepted ones below it and rejected ones at or above it
    best, at, below_good, below_bad = None, 0.0, 0, 0
    for step, a, b in sorted(calibration):
        error = below_good / good + (bad - below_bad) / bad
        edge = step * SPAN / STEPS
        if best is None or (error, abs(edge)) < best:
            best, at = (error, abs(edge)), edge
        below_good, below_bad = below_good + a, below_bad + b
    return at


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; score null where a rule decides."""
    pages = parts(pages)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    key = F.concat("host", F.substring("_rest", F.length("host") + 1, F.length("_rest")))
    pages = pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), key.alias("key"))
    decided = pages.where("by_rule is not null").withColumn("held", F.pmod(F.xxhash64("key"), F.lit(10)) == 0)
    is_good = F.when(F.col("by_rule") == "allow", 1).otherwise(0)
    counts = _grams(decided.where("not held"), "by_rule").groupBy("gram").agg(F.sum(is_good).alias("good"), F.sum(1 - is_good).alias("bad"))
    has = decided.where("not held").agg(F.count_if(F.col("by_rule") == "allow"), F.count_if(F.col("by_rule") == "block")).first()
    if not all(has):
        return pages.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    held = decided.where("held")
    scratch = Scratch(pages.sparkSession, "urls")
    counts = scratch.put(counts)
    scores = scratch.put(_scores(held.select("key").union(pages.where("by_rule is null").select("key")).distinct(), counts))
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-SPAN)), F.lit(SPAN)) * (STEPS / SPAN))
    steps = held.join(scores, "key").groupBy(step.alias("step")).agg(F.sum(is_good).alias("good"), F.sum(1 - is_good).alias("bad"))
    edge = threshold([tuple(r) for r in steps.collect()])
    judged = F.when(F.col("score") < edge, "block").otherwise("allow")
    rest = pages.where("by_rule is null").join(scores, "key").select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")
    ruled = pages.where("by_rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.union(rest)


def brute_force(urls: list[tuple[str, str]], undecided: list[str]) -> list[float]:
    """Scores by plain counting: urls are (key, verdict) that train; for tests."""
    def fold(s: str) -> str:
        return START * ORDER + "".join(c if " " <= c <= "~" else OTHER for c in s) + END

    def model(texts: list[str]) -> dict[str, dict[str, int]]:
        follow: dict[str, dict[str, int]] = {}
        for s in map(fold, texts):
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    d = follow.setdefault(s[i - k : i], {})
                    d[s[i]] = d.get(s[i], 0) + 1
        return follow

    def p(follow: dict[str, dict[str, int]], context: str, c: str) -> float:
        value = FLOOR
        for k in range(ORDER + 1):
            if d := follow.get(context[len(context) - k :]):
                value = (d.get(c, 0) + len(d) * value) / (sum(d.values()) + len(d))
        return value

    good, bad = (model([u for u, v in urls if v == want]) for want in ("allow", "block"))
    out = []
    for s in map(fold, undecided):
        ratio = [math.log(p(good, s[i - ORDER : i], s[i]) / p(bad, s[i - ORDER : i], s[i])) for i in range(ORDER, len(s))]
        out.append(sum(ratio) / len(ratio))
    return out
