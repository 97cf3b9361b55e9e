"""Chat formatting with Spark expressions only.

Template, per run of adjacent turns of one role::

    <|role:ROLE|>\\nTEXT<|next|>TEXT...<|end|>\\n

Control strings all start with "<", and "|" ends a role.  In roles and texts
"\\\\" is written "\\\\s" and "<" is written "\\\\l", in roles also "|" as "\\\\p", so no
control string can occur inside them and the escape is undone by three
replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, NEXT, END = "<|role:", "|>\n", "<|next|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("|"), F.lit("\\p"))


def unescape(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("\\p"), F.lit("|")), F.lit("\\l"), F.lit("<"))
    return F.replace(plain, F.lit("\\s"), F.lit("\\"))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_mask): one row per conversation.

    Turns are collected as structs, sorted by turn (ties by role, then text),
    and neighbours of one role are merged under one header by array
    aggregation.  ``loss_mask`` is run-length coded over code points: an array
    of (chars, in_loss) that covers ``formatted``; exactly the texts of
    ``loss_role`` are in it, neither headers nor separators.

    A null text or role counts as empty, a null turn sorts first, a null
    conversation id forms a conversation of its own; repeated rows are turns
    like any other; an empty table gives an empty table.  Other columns play no
    part.  A conversation is one string, so its length is bounded by a row's.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(one))
    grouped = rows.groupBy(F.col(conv).alias("conv")).agg(turns.alias("turns"))
    # merge adjacent turns of one role: a position starts a run where the role changes
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = F.filter(index, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    grouped = grouped.withColumn("starts", starts).withColumn("n", F.size("starts"))
    runs = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda j: F.struct(
            F.get("turns", F.get("starts", j))["role"].alias("role"),
            F.transform(
                F.slice("turns", F.get("starts", j) + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - F.get("starts", j)),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    grouped = grouped.select("conv", runs.alias("runs"))
    head = lambda r: F.concat(F.lit(OPEN), escape_role(r["role"]), F.lit(SHUT))
    body = lambda r: F.array_join(r["texts"], NEXT)
    formatted = F.array_join(F.transform("runs", lambda r: F.concat(head(r), body(r), F.lit(END))), "")
    bit = lambda n, yes: F.struct(n.cast("long").alias("chars"), yes.alias("in_loss"))
    no = F.lit(False)
    mask = F.flatten(
        F.transform(
            "runs",
            lambda r: F.concat(
                F.array(bit(F.length(head(r)), no)),
                F.flatten(F.transform(r["texts"], lambda t, i: F.when(i > 0, F.array(bit(F.lit(len(NEXT)), no), bit(F.length(t), r["role"] == loss_role))).otherwise(F.array(bit(F.length(t), r["role"] == loss_role))))),
                F.array(bit(F.lit(len(END)), no)),
            ),
        )
    )
    return grouped.select(F.col("conv").alias(conv), formatted.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns, array of (role, text), back from a formatted conversation."""
    runs = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: F.startswith(x, F.lit(OPEN)))

    def turns(run: Column) -> Column:
        cut = F.instr(run, F.lit(SHUT))
        own = unescape(F.substring(run, F.lit(len(OPEN) + 1), cut - F.lit(len(OPEN) + 1)))
        texts = F.split(F.substring(run, cut + F.lit(len(SHUT)), F.length(run)), r"<\|next\|>", -1)
        return F.transform(texts, lambda t: F.struct(own.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; an error where mask and text don't fit.

    Every "<" opens a control string, so one split cuts the text where the mask
    has its entries: a control string, then what it introduces (the end of a
    run introduces nothing).  Work grows with the text's length.
    """
    chunks = F.filter(F.split(formatted, "(?=<)", -1), lambda c: c != "")

    def cut(c: Column) -> Column:
        n = F.when(F.startswith(c, F.lit(NEXT)), F.lit(len(NEXT))).otherwise(F.instr(c, F.lit(SHUT)) + F.lit(len(SHUT) - 1))
        both = F.array(F.substring(c, F.lit(1), n), F.substring(c, n + 1, F.length(c)))
        return F.when(F.startswith(c, F.lit(END)), F.array(c)).otherwise(both)

    pieces = F.flatten(F.transform(chunks, cut))
    fits = lambda p, m: F.coalesce(F.length(p).cast("long") == m["chars"], F.lit(False))
    said = F.zip_with(pieces, mask, lambda p, m: F.when(~fits(p, m), F.raise_error(F.lit("mask and text differ")).cast("string")).when(m["in_loss"], unescape(p)))
    return F.array_join(said, "")
