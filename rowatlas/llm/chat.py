"""Chat formatting with Spark expressions only.

A conversation becomes one string::

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n ...

Turns are sorted structs. Adjacent turns of one role share a block; ``<|im_sep|>``
between their texts keeps the turns apart, so the format can be read back exactly.
Control strings inside roles and texts are broken up by a backslash after their
first character, and backslashes are doubled; both can be undone.

Defined cases: a null text or role is empty; a null turn sorts first; ties of a turn
number are ordered by role, then text; repeated rows are turns of their own; a row
without a conversation id belongs to no other row: it is a conversation by itself, with a null id; an empty table gives
no rows; columns besides the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowatlas.functions.arrays import let, sums_before

START, SEPARATOR, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"
#: What may start a control string of this or another usual template, by its first character.
_CONTROL = r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """Double backslashes and put one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``: a pair of backslashes is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _merged(turns: Column) -> Column:
    """Sorted turns to blocks of one role each: array of (role, texts). A block is the slice from one change of role to the next."""

    def blocks(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        block = lambda s, end: F.struct(F.get(t, s)["role"].alias("role"), F.transform(F.slice(t, s + 1, end - s), lambda x: x["text"]).alias("texts"))
        return let(starts, lambda at: F.transform(at, lambda s, k: block(s, F.coalesce(F.get(at, k + 1), F.size(t)))))

    return let(turns, blocks)


def _pieces(block: Column, loss_role: str) -> Column:
    """What a block adds to the string: array of (s, loss)."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)
    head = F.array(piece(F.concat(F.lit(START), block["role"], F.lit("\n")), no))
    texts = F.flatten(F.transform(block["texts"], lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(SEPARATOR)), no), piece(t, block["role"] == loss_role))))
    return F.concat(head, texts, F.array(piece(F.lit(END + "\n"), no)))


def _spans(pieces: Column) -> Column:
    """Start and length, in bytes of UTF-8, of each piece under the loss mask."""
    size = lambda p: F.octet_length(p["s"]).cast("long")
    span = lambda p, at: F.when(p["loss"], F.struct(at.alias("start"), size(p).alias("len")))
    return let(pieces, lambda ps: F.filter(F.zip_with(ps, sums_before(F.transform(ps, size)), span), lambda x: x.isNotNull()))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans`` (array of start, len, in bytes of UTF-8).

    One shuffle, by conversation. A conversation is one string, so its turns meet in
    one row; that string is what bounds a group.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.replace(escape(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"), F.lit(NEWLINE)).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id())
    collected = df.select(F.col(conv).alias("conv_id"), alone.alias("alone"), one.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = collected.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: _pieces(b, loss_role))).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>", -1)
        said = unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))
        return F.transform(texts, lambda t: F.struct(said.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    part = lambda raw, s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["len"].cast("int")).cast("string"))
    return let(formatted.cast("binary"), lambda raw: F.array_join(F.transform(spans, lambda s: part(raw, s)), ""))
