"""Chat formatting with Spark expressions only, and the way back.

A conversation's turns are collected as structs, sorted, merged into blocks of adjacent turns with the same role by an
array aggregation, and joined to one string:

    ### role: first text</turn>second text of the same role</turn>
    ### other role: ...

In roles and texts, `\\`, `#`, `<` and `:` (the last in roles only) are written `\\b`, `\\h`, `\\l`, `\\c`. So the marks of
the template can't stand inside a text, whatever it says, and reading back gives every turn as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END, LINE = "### ", ": ", "</turn>", "\n"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, mark in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")) + ((":", "\\c"),) * role:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for plain, mark in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: an array of (start, length), the escaped texts of loss_role in formatted (from 1).

    turns has conv_id, turn, role and text. Null roles and texts are empty; a null conv_id is a conversation of its own;
    ties in turn (and null turns, which come first) are ordered by role and text; repeated rows are repeated turns.
    Other columns take no part. A conversation's turns are one row of the result, so they have to fit in a task.
    """
    none = F.lit("")
    turn = F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    block = "array<struct<role:string,texts:array<string>>>"

    def merge(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        own, text = escaped(t["role"], True), escaped(t["text"])
        longer = F.struct(own.alias("role"), F.concat(last["texts"], F.array(text)).alias("texts"))
        new = F.struct(own.alias("role"), F.array(text).alias("texts"))
        same = F.coalesce(last["role"] == own, F.lit(False))
        return F.when(same, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(new))).cast(block)

    blocks = grouped.select("conv_id", F.aggregate("turns", F.array().cast(block), merge).alias("blocks"))
    head = lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(COLON))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(END))), ""), F.lit(LINE))), "")

    # walk over the blocks, keeping the place in the output
    state = "struct<at:int,spans:array<struct<start:int,length:int>>>"
    is_loss = lambda b: b["role"] == escaped(F.lit(loss_role), True)

    def walk_text(s: Column, t: Column) -> Column:
        return F.struct((s["at"] + F.char_length(t) + len(END)).alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), F.char_length(t).alias("length")))).alias("spans")).cast(state)

    def walk_block(s: Column, b: Column) -> Column:
        begin = (s["at"] + F.char_length(head(b))).cast("int")
        inside = F.aggregate(b["texts"], F.struct(begin.alias("at"), s["spans"].alias("spans")).cast(state), walk_text)
        size = F.aggregate(b["texts"], F.lit(0), lambda n, t: n + F.char_length(t) + len(END))
        return F.struct((begin + size + len(LINE)).alias("at"), F.when(is_loss(b), inside["spans"]).otherwise(s["spans"]).alias("spans")).cast(state)

    start = F.struct(F.lit(1).alias("at"), F.array().alias("spans")).cast(state)
    return blocks.select("conv_id", whole.alias("formatted"), F.aggregate("blocks", start, walk_block)["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns, read from the output alone."""
    blocks = F.filter(F.split(formatted, HEAD), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(b, COLON, 1)
        rest = F.substring(b, F.char_length(role) + len(COLON) + 1, F.char_length(b))
        texts = F.split(rest, END)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"], s["length"]))), "")
