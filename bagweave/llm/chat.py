"""Chat formatting with Spark expressions only, and reading the formatted text back.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one
block by array aggregation; blocks and their parts are concatenated. The template:

    <|role|>ROLE\\nTEXT<|part|>TEXT<|end|>   one block; ``<|part|>`` stands between merged turns

Every ``<`` and ``&`` of a role or text is escaped (``&lt;``, ``&amp;``), so no text can hold a control string,
and unescaping gives the text back. The loss mask covers the escaped texts of assistant blocks, without the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagweave.llm.common import bound_to, cut_out, scanned

OPEN, BODY, PART, END = "<|role|>", "<|text|>", "<|part|>", "<|end|>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chat(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start, end: code points of formatted under the loss mask, one span for each assistant turn): one row for each conversation.

    Defined cases: a null role or text is empty; turns sort by turn (null first), then role, then text, so ties
    and repeated rows are all kept in a fixed order; a null conv_id is one conversation; an empty table
    gives an empty result; other columns are ignored. A conversation is one output row, so its turns meet in one task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text"))))

    def lead(t: Column, before: Column) -> Column:
        """What stands before a turn's text: a mark if the turn before has its role, else the end of that block and a new one's start."""
        end = F.when(before.isNull(), "").otherwise(END)
        return F.when(before == t["role"], PART).otherwise(F.concat(end, F.lit(OPEN), escaped(t["role"]), F.lit(BODY)))

    def parts(t: Column) -> Column:
        roles = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform(t, lambda x: x["role"]), F.lit(1), F.size(t) - 1))
        return F.zip_with(t, roles, lambda x, before: F.struct(lead(x, before).alias("lead"), x["text"].alias("text"), (x["role"] == ASSISTANT).alias("loss")))

    def loss(p: Column) -> Column:
        lengths = F.flatten(F.transform(p, lambda x: F.array(F.length(x["lead"]), F.length(x["text"]))))
        spans = lambda at: F.transform(p, lambda x, i: F.struct(F.get(at, 2 * i + 1).alias("start"), F.get(at, 2 * i + 2).alias("end"), x["loss"].alias("loss")))
        return F.transform(F.filter(bound_to(scanned(lengths), spans), lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    text = lambda p: F.concat(F.array_join(F.transform(p, lambda x: F.concat(x["lead"], x["text"])), ""), F.lit(END))
    return turns.select("conv_id", bound_to(bound_to(F.col("turns"), parts), text).alias("formatted"), bound_to(bound_to(F.col("turns"), parts), loss).alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text), read from the formatted text alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(OPEN) + 1, 2147483647), BODY, 1)
        body = F.substring(block, F.length(role) + F.lit(len(OPEN) + len(BODY) + 1), F.length(block))
        return F.transform(F.split(body, r"<\|part\|>", -1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the format holds, by reading it back: turns from the text, the loss from the text under the mask."""
    back = read_chat(formatted)
    loss = F.array_join(F.transform(cut_out(F.col("formatted"), F.col("loss_spans")), unescaped), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
