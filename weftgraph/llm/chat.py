"""Chat formatting with DataFrame expressions only.

A conversation's turns are collected as structs, sorted, and cut into runs of one role; a run becomes
one block::

    ### user:
    first text<turn/>second text of the same role</turn>

``\\``, ``</turn>``, ``<turn/>`` and ``### `` inside a text are escaped, so splitting at the control
strings and unescaping gives the turns back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, NEXT, HEAD = "</turn>", "<turn/>", "### "
#: In this order when escaping, in the opposite order when reading back.
ESCAPES = (("\\", "\\\\"), (END, "<\\/turn>"), (NEXT, "<\\turn/>"), (HEAD, "#\\## "))
_LINE = ("\n", "\\n")


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, list(ESCAPES))


def unescape(c: Column) -> Column:
    return _swap(c, [(b, a) for a, b in reversed(ESCAPES)])


def escape_role(c: Column) -> Column:
    """A role's line break ends the header; it is written as backslash and n."""
    return F.replace(escape(c), F.lit(_LINE[0]), F.lit(_LINE[1]))


def unescape_role(c: Column) -> Column:
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments (array of text, loss): a row for each conv_id.

    The segments concatenate to ``formatted``; loss is true for exactly the texts of ``trained_role``.
    Turns are ordered by (turn, role, text), nulls first; a null text or role counts as empty; repeated rows
    stay. Rows of a null conv_id are one conversation. Other columns are ignored. A conversation is one row
    of output, so its turns meet in one task: its length is bounded by what one row holds.
    """
    parts = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    rows = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    first = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: (i == 1) | (F.get("ts", i - 1)["role"] != F.get("ts", i - 2)["role"]),
    )
    rows = rows.withColumn("first", first)
    block = lambda s, k: F.struct(
        F.get("ts", s - 1)["role"].alias("role"),
        F.transform(
            F.slice("ts", s, F.coalesce(F.get("first", k + 1), F.size("ts") + 1) - s), lambda t: escape(t["text"])
        ).alias("texts"),
    )
    rows = rows.select("conv_id", F.transform("first", block).alias("blocks"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(seg(F.concat(F.lit(HEAD), escape_role(b["role"]), F.lit(":\n")), no)),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda x, i: F.array(
                            seg(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), no), seg(x, b["role"] == trained_role)
                        ),
                    )
                ),
                F.array(seg(F.lit(END + "\n"), no)),
            ),
        )
    )
    rows = rows.select("conv_id", segments.alias("segments"))
    return rows.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text, formatted_chars: parsed from what was formatted."""
    blocks = F.filter(F.split("formatted", END + "\n"), lambda b: b != "")
    parsed = F.transform(
        blocks,
        lambda b: F.struct(unescape_role(_header(b)).alias("role"), F.split(_body(b), NEXT).alias("texts")),
    )
    turns = F.flatten(
        F.transform(parsed, lambda p: F.transform(p["texts"], lambda x: F.struct(p["role"].alias("role"), unescape(x).alias("text"))))
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def _header(block: Column) -> Column:
    line = F.substring_index(block, "\n", 1)
    return F.substr(line, F.lit(len(HEAD) + 1), F.length(line) - len(HEAD) - 1)


def _body(block: Column) -> Column:
    return F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)
