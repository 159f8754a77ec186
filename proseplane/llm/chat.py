"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns lie one after another on a line of tokens; the prefix sums of their sizes are their
places. The line is cut into cells of equal length. Turns inside a cell form a window; a turn across a
boundary joins the window of the cell in which it ends where that fits, else it is a window of its own. So
windows hold whole turns, and their own turns take at most a cell or are one longer turn. Each window but
the first repeats the system turn and the last turns of the window before it, up to the history's budget.
The loss mask covers the assistant's texts, except in repeated turns, so each text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseplane.llm.common import words_of

BUDGET = 1024
HISTORY = 256
#: Tokens that the marks of a turn take.
OVERHEAD = 3
#: Turn numbers that share a partial prefix sum, so that one long conversation spreads over tasks. Windows and
#: history don't depend on it.
BLOCK = 1024
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"


def escaped(s: Column, role: bool = False) -> Column:
    r"""Free of `#` and `</` (roles: and of `:`): \ becomes \\, # \h, </ <\/, : \c."""
    s = F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("</"), F.lit("<\\/"))
    return F.replace(s, F.lit(":"), F.lit("\\c")) if role else s


def unescaped(s: Column) -> Column:
    """The inverse of escaped."""

    def part(p: Column) -> Column:
        for mark, char in (("\\h", "#"), ("\\/", "/"), ("\\c", ":")):
            p = F.replace(p, F.lit(mark), F.lit(char))
        return p

    return F.array_join(F.transform(F.split(s, r"\\\\", -1), part), "\\")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"], role=True), F.lit(SEPARATOR), escaped(turn["text"]), F.lit(CLOSE))


def format_windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, tokens=words_of) -> DataFrame:
    """One row for each window: conv_id, start, formatted, loss_spans, n_repeated, n_turns.

    A conversation's windows are in the order of start (place of their first own turn on the line of tokens).
    loss_spans are (first code point, length) in formatted; the first
    n_repeated turns are repeated context. Turns are in the order of turn (null first), role, text; null roles
    and texts are empty; repeated rows are turns of their own; a null conv_id is a conversation. A system turn
    counts as such in the first place. A window takes at most `budget` tokens (words and OVERHEAD for each
    turn) unless one turn alone is longer than what history and system turn leave, or these leave under a
    quarter. Other columns are ignored; no rows give no windows.

    Texts are shuffled by block for their places, by cell and by window, never by conversation.
    """
    c = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.concat(F.when(F.col(conv_id).isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col(conv_id).cast("string"), F.lit(""))).alias("conv"),
        F.coalesce(F.floor(F.col(turn) / BLOCK).cast("string"), F.lit("null")).alias("block"),
    ).withColumn("t", (tokens(F.col("text")) + F.lit(OVERHEAD)).cast("long"))
    system = F.col("role") == "system"
    heads = F.min(F.struct("turn", "role", F.when(system, F.col("text")).alias("text"), "t"))
    blocks = c.groupBy("conv", "block").agg(F.sum("t").alias("total"), F.min("turn").alias("low"), heads.alias("head"))
    line = Window.partitionBy("conv").orderBy("low")
    first = F.first("head").over(line)
    blocks = blocks.withColumns({"before": F.sum("total").over(line) - F.col("total"), "all": F.sum("total").over(Window.partitionBy("conv")), "head": first, "nth": F.row_number().over(line)})
    leads = F.col("head.role") == "system"
    sums = blocks.select("conv", "block", "before", "all", F.when(leads, F.col("head.t")).otherwise(F.lit(0)).cast("long").alias("lead"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("upto", F.sum("t").over(inside)).join(sums, ["conv", "block"])
    c = c.withColumn("q", F.col("before") + F.col("upto") - F.col("t") - F.col("lead"))  # the system turn lies below 0
    c = c.withColumns({"is_lead": F.col("q") < 0, "stride": F.greatest(F.lit(budget - history) - F.col("lead"), F.lit(budget // 4))})
    c = c.withColumn("cell", F.when(F.col("is_lead"), F.lit(-1)).otherwise(F.floor((F.col("q") + F.col("t") - 1) / F.col("stride"))).cast("long"))
    cell = Window.partitionBy("conv", "cell")
    c = c.withColumn("alone", ~F.col("is_lead") & (F.floor(F.col("q") / F.col("stride")) < F.col("cell")) & (F.sum("t").over(cell) > F.col("stride")))
    window = Window.partitionBy("conv", "cell", "alone")
    c = c.withColumns({"start": F.min("q").over(window), "end": F.max(F.col("q") + F.col("t")).over(window)})
    again = (F.col("end") - F.col("q") <= history) & (F.col("end") < F.col("all") - F.col("lead"))
    place = lambda at, repeated: F.struct(at.cast("long").alias("at"), F.lit(repeated).alias("repeated"))
    places = F.when(F.col("is_lead"), F.array(place(F.lit(0), False))).when(again, F.array(place(F.col("start"), False), place(F.col("end"), True))).otherwise(F.array(place(F.col("start"), False)))
    rows = c.withColumn("w", F.explode(places))
    item = F.struct(F.when(F.col("is_lead"), F.lit(-1)).otherwise(F.col("q")).cast("long").alias("q"), F.col("w.repeated").alias("repeated"), "role", "text")
    # a window's turns are bounded by the budget, or are one turn and its context
    windows = rows.groupBy("conv", "conv_id", F.col("w.at").alias("start")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    repeat = F.struct(F.lit(-1).cast("long").alias("q"), F.lit(True).alias("repeated"), F.col("head.role").alias("role"), F.col("head.text").alias("text"))
    repeats = blocks.where((F.col("nth") == 1) & leads).select("conv", repeat.alias("head"))
    windows = windows.join(repeats, "conv", "left")
    windows = windows.withColumn("turns", F.when((F.col("start") > 0) & F.col("head").isNotNull(), F.concat(F.array("head"), F.col("turns"))).otherwise(F.col("turns")))
    lengths = F.transform("turns", lambda x: F.struct((F.length(rendered(x))).alias("n"), F.length(escaped(x["text"])).alias("body"), ((x["role"] == "assistant") & ~x["repeated"]).alias("target")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<first:int,length:int>>)").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        span = F.struct((a["at"] + x["n"] - x["body"] - len(CLOSE)).alias("first"), x["body"].alias("length"))
        return F.struct((a["at"] + x["n"]).alias("at"), F.when(x["target"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return windows.select(
        "conv_id", "start", F.array_join(F.transform("turns", rendered), "").alias("formatted"), F.aggregate(lengths, zero, step, lambda a: a["spans"]).alias("loss_spans"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"), F.size("turns").alias("n_turns"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, read from its marks alone."""
    pieces = F.split(formatted, CLOSE, -1)

    def one(p: Column) -> Column:
        at = F.locate(":", p)
        return F.struct(unescaped(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescaped(F.substring(p, at + len(SEPARATOR), F.length(p))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, with nothing between."""
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["first"] + 1, s["length"])), ""))
