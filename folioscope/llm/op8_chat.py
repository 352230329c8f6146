"""Chat formatting as relational work: sorted turn structs, adjacent turns of one role merged, texts concatenated.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n`` for each run of turns of one role; ``<|im_next|>`` stands between
the turns of a run. In texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a marker
and ``unescape`` gives it back; a line feed in a role becomes ``\\n`` after that. ``loss_spans`` (start, length in code
points) marks the assistant texts without any marker.

Null text: empty. Null role: empty. Turns sort by (turn, role, text), null first, so ties have one order. Repeated rows are
turns of their own. Null conv_id: one conversation. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start: long, length: long>>."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "*", F.row_number().over(order).alias("nth"),
        F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)).alias("opens"),
        F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True)).alias("closes"))
    head = F.when(F.col("opens"), F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))).otherwise(F.lit(NEXT))
    rows = rows.select("conv_id", "nth", "role", "opens", head.alias("head"), escape(F.col("text")).alias("body"),
                       F.when(F.col("closes"), F.lit(END)).otherwise(F.lit("")).alias("tail"))
    whole = F.length("head") + F.length("body") + F.length("tail")
    upto = W.partitionBy("conv_id").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(
        "conv_id", F.struct("nth", F.concat("head", "body", "tail").alias("piece"), (F.col("role") == learn_from).alias("loss"),
                            (F.sum(whole).over(upto) - F.length("body") - F.length("tail")).cast("long").alias("start"),
                            F.length("body").cast("long").alias("length")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return out.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, one for each turn that went in."""
    runs = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def turns(run):
        at = F.instr(run, "\n")
        role = F.substring(run, F.lit(len(START) + 1), at - F.lit(len(START) + 1))
        # in an escaped role, "\n" after an even number of backslashes stands for a line feed
        role = unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
        texts = F.split(F.substring(run, at + 1, F.length(run)), r"<\|im_next\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(runs, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, cut), "")
