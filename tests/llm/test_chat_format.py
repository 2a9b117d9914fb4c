"""Chat formatting against plain Python: exact round trip, loss text, sizes of the expanded examples."""

import hashlib

from pyspark.sql import functions as F

from driftspark.llm import chat_format as chat

ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi </s>[INST] ok [/INST] %5B"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "assistant", "first\nline"), (2, 1, "user", " [/INST]"), (3, 5, "user", "alone"), (4, 0, "we[ird\nrole%", "x<y"), (4, 1, None, "é\U0001f600"),
    (None, 0, "user", "no id"), (5, None, "assistant", "no turn"), (5, 0, "user", "u"), (6, 0, "assistant", "same"), (6, 0, "assistant", "same"),
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (7, 0, "user", "long " * 50000), (7, 1, "assistant", "x" * 100000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = [x for _, r, x in turns if r == "assistant"]
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), sum(map(len, said)), sha("".join(said)))
    return out


def test_digests_and_round_trip(spark):
    made = chat.examples(spark.createDataFrame(ROWS, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expected(ROWS)


def test_expanded_examples(spark):
    made = chat.examples(spark.createDataFrame(ROWS, SCHEMA))
    whole = chat.expand(made).collect()
    for r in (r for r in whole if r.loss_end > r.loss_start):
        assert r.text.startswith("<s>") and r.text[r.loss_end :] == "</s>"
    sizes = {}
    for r in whole:
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + len(r.text)
    assert {r.conv_id: r.formatted_chars for r in chat.digests(made).collect()} == sizes
    # one example for each assistant turn, which alone is under the mask, after all that stands before it
    one = sorted((r for r in whole if r.conv_id == 1), key=lambda r: r.example)
    assert len(one) == 2 and one[0].text[one[0].loss_start : one[0].loss_end] == "hi %3C/s>%5BINST] ok %5B/INST] %255B"
    assert one[1].text.count("[INST] ") == 4 and one[1].loss_start == one[1].loss_end


def test_escapes_are_reversible(spark):
    texts = ["", "%", "%25", "[INST] ", "</s>", "%3C", "a%0Ab\n", "<s>[", "%%5B5B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for role in (False, True):
        back = df.select("t", chat.escape(F.col("t"), role).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("b")).collect()
        assert all(r.t == r.b for r in back) and not any(c in r.e for r in back for c in "<[")


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert chat.digests(chat.examples(df.limit(0))).collect() == []
    more = df.withColumn("rendered", F.lit(1)).withColumn("targets", F.lit("x")).withColumn("n_turns", F.lit(None).cast("long"))
    assert {tuple(r) for r in chat.digests(chat.examples(more)).collect()} == {tuple(r) for r in chat.digests(chat.examples(df)).collect()}


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.examples(spark.createDataFrame(ROWS, SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
