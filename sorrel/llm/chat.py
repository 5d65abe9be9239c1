"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only
its reply is trainable. Turns after the last reply (all turns, where there is no reply) make
one more example without a target, so that a conversation can be read back from its examples.

A turn is written as ``<s>[INST]`` role ``[/INST]`` text ``</s>``. Where a role or text holds
one of these control strings, also with backslashes after its first character, one backslash
is put there; reading takes it out again. So no written text ever holds a control string, and
every string survives the round trip.

An example's text is quadratic in a conversation's turns, by the method. A conversation is
brought together in one row, because its digest needs all of it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the control strings of the template
TURN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(<|\[)(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"(<|\[)\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    """One more backslash after the first character of every control string."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _written(turn: Column) -> Column:
    return F.concat(F.lit(TURN + ROLE), escape(turn["role"]), F.lit(TEXT), escape(turn["text"]), F.lit(END))


def expand(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length) per assistant turn, and one row more
    for a conversation that does not end with one.

    ``loss_start`` (from 1) and ``loss_length`` mark the trainable code points of ``formatted``; a
    row without a target has length 0. Rows are ordered by turn; null turns come first, ties go by
    role and text. Null role or text is empty, a null conversation id is one conversation, and an
    empty table gives no row.
    """
    turns = rows.groupBy(F.col(conv_col).alias("_conv")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))).alias("_turns"))
    written = turns.select("_conv", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), _written(t).alias("w"))).alias("_w"))
    last = F.element_at("_w", -1)["role"]
    ends = F.filter(F.transform("_w", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    ends = F.when(last == "assistant", ends).otherwise(F.concat(ends, F.array(F.size("_w"))))
    each = written.select("_conv", "_w", F.posexplode(ends).alias("example", "_end"))
    target = F.element_at("_w", F.col("_end"))
    head = F.lit(TURN + ROLE + "assistant" + TEXT)
    context = F.concat_ws("", F.transform(F.slice("_w", F.lit(1), F.col("_end") - 1), lambda t: t["w"]))
    parts = each.select("_conv", "example", context.alias("_context"), target["w"].alias("_last"), (target["role"] == "assistant").alias("_reply"))
    return parts.select(
        F.col("_conv").alias("conv_id"), F.col("example").cast("long").alias("example"), F.concat("_context", "_last").alias("formatted"),
        F.when(F.col("_reply"), F.length("_context") + F.length(head) + 1).otherwise(1).cast("long").alias("loss_start"),
        F.when(F.col("_reply"), F.length("_last") - F.length(head) - len(END)).otherwise(0).cast("long").alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<s>\[INST\]"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.split_part(p, F.lit(TEXT), F.lit(1))).alias("role"),
        unescape(F.split_part(F.split_part(p, F.lit(TEXT), F.lit(2)), F.lit(END), F.lit(1))).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the examples."""
    rows = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("_chars"),
        F.when(F.col("loss_length") > 0, unescape(F.substring("formatted", F.col("loss_start").cast("int"), F.col("loss_length").cast("int"))))
        .otherwise(F.lit("")).alias("_loss"), "formatted")
    longest = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("_all"), F.sum("_chars").alias("formatted_chars"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("example", "_loss"))), lambda e: e["_loss"])).alias("_loss"))
    read = longest.withColumn("_turns", read_turns(F.col("_all")))
    text = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.encode(text, "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.encode(F.col("_loss"), "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
