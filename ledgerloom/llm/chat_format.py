r"""Chat formatting by prefix-target expansion.

Method. Every assistant turn becomes an example: all turns up to it, rendered with the template, of which only that
reply is trainable. Turns after the last assistant turn (and conversations without one) become one more example without
a trainable part, so that nothing of a conversation is lost.

Template. A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and texts a backslash is doubled, and
every control string gets a backslash after its first character, so it never occurs there; ``unescape`` reverses both.
Control strings never overlap one another, so replacing them one by one is exact.

The loss mask is ``loss_start``, ``loss_end``: code points of ``formatted``, end exclusive, null without a trainable part;
it covers the escaped reply.

Scale. One shuffle, of turns by conversation; expansion and reading back are narrow. A conversation's turns meet in one
task because each example holds them all; examples of a long conversation leave one at a time.

Defined results. Null text and null role count as empty; turns that tie are ordered by role, then text; a null turn number
comes first; a null conv_id is one conversation. Repeated rows are turns of their own. An empty table gives no examples.
Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates and tokenizers give a meaning of their own.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """A doubled backslash is one; any other backslash was put in."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, whole): ``example`` numbers a conversation's examples from 0 and
    ``whole`` marks the one that holds all its turns."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), clean("role").alias("role"), clean("text").alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    body = lambda t: escape(t["text"])
    rendered = F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("reply"), F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), body(t).alias("body")))
    one = grouped.select("conv_id", rendered.alias("turns")).withColumn("text", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["reply"] | (i == last))
    out = one.withColumn("last", last).select("conv_id", "turns", "text", "last", F.posexplode(ends).alias("example", "end"))
    before = F.when(F.col("end") > 0, F.array_join(F.slice("text", 1, F.col("end")), "")).otherwise("")
    turn = F.get("turns", F.col("end"))
    out = out.select("conv_id", F.col("example").cast("long").alias("example"), before.alias("before"), F.get("text", F.col("end")).alias("own"), turn.alias("turn"), (F.col("end") == F.col("last")).alias("whole"))
    start = F.length("before") + F.length("turn.head")
    return out.select(
        "conv_id", "example", F.concat("before", "own").alias("formatted"),
        F.when(F.col("turn.reply"), start).cast("long").alias("loss_start"), F.when(F.col("turn.reply"), start + F.length("turn.body")).cast("long").alias("loss_end"), "whole",
    )


def parse(formatted: Column) -> Column:
    """Turns, as an array of (role, text), of a formatted example."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda p: p != "")

    def turn(p: Column) -> Column:
        fields = F.split(F.substring(p, len(START) + 1, 2**31 - 1), r"\Q" + SEP + r"\E")
        return F.struct(unescape(F.get(fields, 0)).alias("role"), unescape(F.get(fields, 1)).alias("text"))

    return F.transform(parts, turn)


def read_back(found: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    span = F.expr("substring(formatted, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))")
    each = found.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"), unescape(span).alias("loss"),
        F.when(F.col("whole"), parse(F.col("formatted"))).alias("turns"),
    )
    one = each.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.first("turns", ignorenulls=True).alias("turns"),
    )
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
