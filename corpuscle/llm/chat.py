"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*          turn := "<|im_start|>" role LF text "<|im_end|>" LF

Neither role nor text may hold a control string, and a role no line break; ``parse`` gives null for a turn that breaks this.  Role and text of every turn are each rendered as
they are in a turn of their own, parsed again and compared with their source; where that fails they are escaped.  The finished conversation is parsed once more.  Escaping puts ``\\:`` behind the first character of each control string, doubles backslashes, and writes a line break
in a role as ``\\n``; it can be undone, so the second rendering parses to the source, and ``identical`` says whether it did for whole conversations.

The loss mask covers the texts of the assistant.  A conversation is one row of the output, so its turns meet in one task; conversations are spread freely.

Edge cases: null roles and texts are empty; a null conv_id is a conversation of its own; turns are ordered by turn (null first), then role, then text, so
repeated turns all stay; an empty table gives no conversation; other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import col

BEGIN, END = "<|im_start|>", "<|im_end|>"
# fixed values: strings that some chat template gives a meaning
CONTROL = (BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ANY = "|".join(re.escape(c) for c in CONTROL)
_FIRST = f"(?=(?:{_ANY}))(.)"


def escape(text: Column, line_breaks: bool = False) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _FIRST, r"$1\\:")
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_breaks else out


def unescape(text: Column) -> Column:
    """Undo ``escape``: between doubled backslashes, ``\\:`` is nothing and ``\\n`` a line break."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\:"), F.lit("")), F.lit("\\n"), F.lit("\n"))
    return F.when(~F.contains(text, F.lit("\\")), text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\"))


def render(role: Column, text: Column) -> Column:
    """One turn, its contents as they are."""
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END + "\n"))


def _reads_back(role: Column, text: Column) -> Column:
    """Whether the turn, rendered without escapes, is parsed to one turn equal to its source."""
    return parse(render(role, text)) == F.array(F.struct(role.alias("role"), text.alias("text")))


def parse(formatted: Column) -> Column:
    """Array of (role, text) that the grammar finds in a formatted conversation, null for what is no turn."""
    turns = F.split(formatted, re.escape(END) + "\n")
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def turn(t):
        body = F.substring(t, F.lit(len(BEGIN) + 1), F.length(t))
        cut = F.instr(body, F.lit("\n"))
        valid = F.startswith(t, F.lit(BEGIN)) & (cut > 0) & ~body.rlike(_ANY)
        return F.when(valid, F.struct(unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text")))

    return F.transform(turns, turn)


def format_chats(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Per conversation: formatted, loss_spans (code points of formatted, ends exclusive), turns as read back, escaped_turns, identical."""
    flat = rows.select(col(conversation).alias("id"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    shown = (flat.withColumn("head", F.concat(F.lit(BEGIN), F.when(_reads_back(F.col("role"), F.lit("")), F.col("role")).otherwise(escape(F.col("role"), True)), F.lit("\n")))
             .withColumn("body", F.when(_reads_back(F.lit(""), F.col("text")), F.col("text")).otherwise(escape(F.col("text"))))
             .withColumn("size", F.length("head") + F.length("body") + len(END) + 1))
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    placed = (shown.withColumn("place", F.row_number().over(order))
              .withColumn("start", F.sum(F.col("size").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.length("head")))
    entry = F.struct("place", "role", "text", "head", "body", "start")
    whole = placed.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("source"))
    span = lambda t: F.struct(t.start.alias("start"), (t.start + F.length(t.body)).alias("end"))
    out = (whole.withColumn("formatted", F.array_join(F.transform("source", lambda t: F.concat(t["head"], t.body, F.lit(END + "\n"))), ""))
           .withColumn("turns", parse(F.col("formatted")))
           .withColumn("loss_spans", F.transform(F.filter("source", lambda t: t.role == trained), span))
           .withColumn("escaped_turns", F.size(F.filter("source", lambda t: (t.body != t.text) | (t["head"] != F.concat(F.lit(BEGIN), t.role, F.lit("\n"))))))
           .withColumn("identical", F.col("turns") == F.transform("source", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))))
    return out.select(F.col("id").alias(conversation), "formatted", "loss_spans", "turns", "escaped_turns", "identical")


def masked(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
