"""Chat formatting with Spark expressions only: sort turn structs, merge equal roles, concatenate.

    <turn:ROLE>text<next/>text</turn>

Adjacent turns of one role share a block; ``<next/>`` keeps the border between them. A control string
inside a text gets a backslash after its ``<`` (one more if it has some already), so no text can open or
close a turn, and taking one away gives the text back. Roles are percent-encoded where they hold ``<``,
``>`` or ``%``.

Defined results: NULL texts and roles count as empty; a NULL turn comes first; turns with equal numbers
go by role, then text; repeated rows are all kept; rows without a conversation id are conversations of
one turn each. A conversation is one output row, so only its own turns are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column

CONTROL = r"(turn:|/turn>|next/>)"
BEGIN, JOINT, END = "<turn:", "<next/>", "</turn>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<(\\*){CONTROL}", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<\\(\\*){CONTROL}", "<$1$2")


def encode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3E"), F.lit(">")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation.

    ``loss_spans`` are (start, end) in code points of ``formatted``, end exclusive: the escaped text of
    each turn of the role to learn, without marks.
    """
    alone = F.when(column(conv).isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        column(conv).alias("conv_id"), alone.alias("alone"),
        F.struct(
            column(turn).alias("turn"), F.coalesce(column(role).cast("string"), F.lit("")).alias("role"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text")
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    # each piece: the marks before a text, the text, the marks after it; a block opens where the role changes
    def piece(t: Column, i: Column) -> Column:
        before, after = F.get("ts", i - 1), F.get("ts", i + 1)
        opens = before.isNull() | (before["role"] != t["role"])
        closes = after.isNull() | (after["role"] != t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(BEGIN), encode_role(t["role"]), F.lit(">"))).otherwise(F.lit(JOINT)).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == learn).alias("learn"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("ts", piece).alias("ps"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.length(p["tail"])).alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("ps", empty, add)["spans"].alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns of formatted conversations: (conv_id, turns array<struct<role,text>>, loss_text, formatted)."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(BEGIN) + 1))
        at = F.locate(">", inner)
        role = decode_role(F.substr(inner, F.lit(1), at - 1))
        return F.transform(F.split(F.substr(inner, at + 1), JOINT, -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
