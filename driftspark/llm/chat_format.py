"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes an example of its own: all preceding turns are context, and only that reply is
trainable.  Turns after the last assistant turn (or all, if there is none) form one more example without a
target, so that no turn is lost.

Template.  ``<s>`` opens an example.  A turn is ``[INST] role\\n text [/INST]`` where it is context and
``[INST] role\\n`` + text + ``</s>`` where it is the target.  Texts and roles are escaped first, so that a
control string never comes from inside one: ``%`` becomes ``%25``, ``<`` ``%3C``, ``[`` ``%5B``, and in roles
a line feed ``%0A``.  Control strings all begin with ``<`` or ``[``, so undoing the four codes is exact.

Size.  The examples of a conversation are prefixes of one rendering, so with n turns written out they grow as
n squared in characters; ``examples`` keeps each example's context as a length of the conversation's
rendering (``context_chars``) beside one copy of the rendering per conversation, and ``expand`` writes them
out where files of whole examples are wanted.

Edge cases.  Null text or role: empty.  Turns are taken in the order of turn (null first), then role, then
text, so repeated rows stay repeated turns in a defined order.  A null conv_id is a conversation like any
other.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import own_columns

OPEN, TURN, END_CONTEXT, END_TARGET = "<s>", "[INST] ", " [/INST]", "</s>"
ASSISTANT = "assistant"


def escape(column: Column, role: bool = False) -> Column:
    """Free of control strings; undone by unescape."""
    codes = [("%", "%25"), ("<", "%3C"), ("[", "%5B")] + ([("\n", "%0A")] if role else [])
    for plain, code in codes:
        column = F.replace(column, F.lit(plain), F.lit(code))
    return column


def unescape(column: Column) -> Column:
    for plain, code in (("\n", "%0A"), ("[", "%5B"), ("<", "%3C"), ("%", "%25")):
        column = F.replace(column, F.lit(code), F.lit(plain))
    return column


def examples(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, rendered, targets.

    rendered: ``<s>`` and all turns as context.  targets: for each example in order, a struct of
    context_chars (the length of the rendering's prefix that is its context, ``<s>`` included), target (the
    rendered target turn with its ``</s>``; empty for the example without one) and loss_start, loss_end (code
    points of the example under the loss mask).
    """
    rows = own_columns(conversations, "conv_id", "turn", "role", "text")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    head = F.concat(F.lit(TURN), escape(role, role=True), F.lit("\n"))
    rows = rows.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END_CONTEXT)))
    one = one.select("conv_id", "turns", shown.alias("shown"), F.size("turns").alias("n"))
    # the length of the rendering before turn i, by a running sum
    ends = F.aggregate(
        "shown",
        F.array(F.lit(len(OPEN)).cast("int")),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s))),
    )
    one = one.withColumn("ends", ends)
    made = F.filter(
        F.transform(
            "turns",
            lambda t, i: F.when(
                t["role"] == ASSISTANT,
                F.struct(
                    F.get("ends", i).alias("context_chars"),
                    F.concat(t["head"], t["body"], F.lit(END_TARGET)).alias("target"),
                    (F.get("ends", i) + F.length(t["head"])).alias("loss_start"),
                    (F.get("ends", i) + F.length(t["head"]) + F.length(t["body"])).alias("loss_end"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    size = F.element_at("ends", -1)
    rest = F.when(
        F.element_at("turns", -1)["role"] != ASSISTANT,
        F.array(F.struct(size.alias("context_chars"), F.lit("").alias("target"), size.alias("loss_start"), size.alias("loss_end"))),
    ).otherwise(F.array())
    return one.select("conv_id", F.concat(F.lit(OPEN), F.array_join("shown", "")).alias("rendered"), F.concat(made, rest).alias("targets"))


def expand(formatted: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end: whole examples, each with its own context."""
    one = formatted.select("conv_id", "rendered", F.posexplode("targets").alias("example", "t"))
    text = F.concat(F.substring("rendered", F.lit(1), F.col("t.context_chars")), F.col("t.target"))
    return one.select("conv_id", "example", text.alias("text"), "t.loss_start", "t.loss_end")


def _turn(shown: Column) -> Column:
    """role, \\n, text, \\n of a rendered turn without its end."""
    body = F.replace(shown, F.lit(TURN), F.lit(""))
    at = F.locate("\n", body)
    return F.concat(unescape(F.substring(body, F.lit(1), at)), unescape(F.substring(body, at + 1, F.length(body))), F.lit("\n"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says of each conversation, read back from the output alone.

    The last example holds every turn: its context, cut at the ends of turns, and its target.  The loss text
    is read from each example by its mask: mask positions minus context_chars cut it from the target.
    """
    last = F.element_at("targets", -1)
    context = F.substring("rendered", F.lit(len(OPEN) + 1), last["context_chars"] - len(OPEN))
    parts = F.filter(F.split(context, r" \[/INST\]"), lambda s: F.startswith(s, F.lit(TURN)))
    target = F.replace(last["target"], F.lit(END_TARGET), F.lit(""))
    turns = F.when(last["target"] == "", parts).otherwise(F.concat(parts, F.array(target)))
    loss = F.transform(
        "targets",
        lambda t: unescape(F.substring(t["target"], t["loss_start"] - t["context_chars"] + 1, t["loss_end"] - t["loss_start"])),
    )
    chars = F.aggregate("targets", F.lit(0).cast("long"), lambda a, t: a + t["context_chars"] + F.length(t["target"]))
    one = formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss"), chars.alias("formatted_chars"))
    return one.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", _turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
