"""Chat formatting with relational operators only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``; adjacent turns of one role share one frame, their
texts parted by ``<|im_sep|>``. Control strings inside roles and texts are escaped with two-character codes, so
that the output can be split at control strings and read back without loss.

Defined cases: a null text or role is the empty string, null turns come first, equal turns are ordered by role
and then text, repeated rows are turns of their own, rows with a null conversation id form one conversation, a conversation is one string of the
result, however long (its turns are sorted with spilling and joined in one task, in linear time), an empty table gives no rows, and columns that are
not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshelf.llm.common import let, text_of

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings that must not stand in a text, and their codes. The escape character comes first.
CODES = [("~", "~0"), ("<|", "~1"), ("</s>", "~2"), ("<s>", "~3"), ("[INST]", "~4"), ("[/INST]", "~5")]
ROLE_CODES = [*CODES, ("\n", "~6")]


def escape(c: Column, codes=CODES) -> Column:
    for raw, code in codes:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column, codes=CODES) -> Column:
    for raw, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """conv, formatted STRING, loss_spans ARRAY<STRUCT<start, stop, begin, upto>> (code points and bytes of formatted).

    One shuffle by conversation serves the windows and both aggregations. Offsets are running sums over the
    sorted turns, so the work is linear in a conversation's length.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), escape(text_of(role), ROLE_CODES).alias("r"), escape(text_of(text)).alias("x"))
    order = Window.partitionBy("c").orderBy("t", "r", "x")
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("n"),
        (~F.col("r").eqNullSafe(F.lag("r").over(order))).alias("first"),
        (~F.col("r").eqNullSafe(F.lead("r").over(order))).alias("last"),
    )
    head = lambda length: F.when(F.col("first"), length("r") + len(OPEN) + 1).otherwise(len(SEP)).cast("long")
    size = lambda length: head(length) + length("x") + F.when(F.col("last"), len(CLOSE)).otherwise(0)
    so_far = Window.partitionBy("c").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    place = lambda length: F.sum(size(length)).over(so_far) - size(length) + head(length)
    rows = rows.select("c", "n", "r", "x", F.sum(F.col("first").cast("int")).over(so_far).alias("run"), place(F.length).alias("at"), place(F.octet_length).alias("begin"))
    merged = rows.groupBy("c", "run", "r").agg(F.sort_array(F.collect_list(F.struct("n", "x", "at", "begin"))).alias("texts"))
    block = F.concat(F.lit(OPEN), "r", F.lit("\n"), F.array_join(F.col("texts.x"), SEP), F.lit(CLOSE))
    spans = F.transform("texts", lambda s: F.struct(s.at.alias("start"), (s.at + F.length(s.x)).alias("stop"), s.begin.alias("begin"), (s.begin + F.octet_length(s.x)).alias("upto")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,begin:bigint,upto:bigint>>")
    blocks = merged.select("c", "run", block.alias("block"), F.when(F.col("r") == loss_role, spans).otherwise(none).alias("spans"))
    whole = blocks.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("run", "block", "spans"))).alias("b"))
    return whole.select(F.col("c").alias(conv), F.array_join("b.block", "").alias("formatted"), F.flatten("b.spans").alias("loss_spans"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns ARRAY<STRUCT<role, text>> and loss_texts ARRAY<STRING>: the turns from the formatted strings alone, the loss texts from these and loss_spans."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        frame = F.substring(block, len(OPEN) + 1, 2147483647)
        role = F.substring_index(frame, "\n", 1)
        body = F.substr(frame, F.length(role) + 2)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda x: F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(x).alias("text")))

    # Bytes are reached at once, where code points would have to be counted from the start for each span.
    text = lambda raw, s: F.substr(raw, (s.begin + 1).cast("int"), (s.upto - s.begin).cast("int")).cast("string")
    loss = let(F.col("formatted").cast("binary"), lambda raw: F.transform("loss_spans", lambda s: unescape(text(raw, s))))
    return formatted.select(conv, "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_texts"))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted, conv).select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
