"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose the windows. The budget first pays for the conversation's system turn and
for `history`; what is left is the room of a window's own turns. A turn belongs to window floor(tokens
before it / half the room), and a turn of more than half the room stands alone, so that a window of several
turns never exceeds the budget. Prefix sums and windows are those of a run of 512 turn numbers, so that a
conversation of any length is spread over tasks. Each window repeats a leading system turn and the last
turns of the window before it in its run; what is repeated is not a target again.

Two rules for turns that are too long: a system turn that would leave a room of less than an eighth of the
budget is shown once and not repeated; a turn that stands alone takes the system turn and history with it
only as far as the budget holds, and where it is longer than the budget by itself its window is, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run is 2 ^ RUN turn numbers.
RUN = 9
BEGIN, END, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    """Every control string starts with `<` or `[`; both, and the escape sign itself, are written as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def turn_tokens(text: Column) -> Column:
    """The size of a turn: words and single other signs, plus four for its marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + 4


def windows(turns: DataFrame, *, budget: int = 1024, history: int = 128, target: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, window, text, loss, repeated, tokens): formatted windows of each conversation.

    `loss` holds the code-point ranges (start, stop) of the targets: each text of role `target` exactly
    once over all windows. `repeated` counts the leading turns that an earlier window has already shown.
    `window` grows from window to window of a conversation; `tokens` is the size of its turns, above
    `budget` only where a single turn is. Turns are ordered by number, then role and text (nulls first);
    repeated rows are turns of their own; a null text or role is empty; each row with a null conversation is
    a conversation of its own, equal ones together. A turn of any length is one value. Other columns, of any
    name, are left out. No turns give no windows.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history is half of the budget at most")
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first_of_all = F.lit(-(1 << 40))
    rows = rows.select(
        "c", F.coalesce(F.col("c").cast("string"), F.lit("")).alias("g"), F.when(F.col("c").isNull(), F.xxhash64("t", "role", "text")).otherwise(F.lit(0)).alias("h"), F.coalesce(F.shiftright(F.col("t").cast("long"), RUN), first_of_all).alias("run"),
        "t", "role", "text", turn_tokens(F.col("text")).alias("n"),
    )
    group = ["g", "h"]
    # the first turn of a conversation, if it is a system turn: the smallest number, and before "system" no other role of that number
    rank = F.coalesce("t", first_of_all) * 4 + F.when(F.col("role") == "system", 1).when(F.col("role") < "system", 0).otherwise(2)
    least = rows.groupBy(*group).agg(F.min(rank).alias("least"))
    first = rows.where(F.col("role") == "system").withColumn("rank", rank).join(least, group).where("rank = least").groupBy(*group).agg(F.min("text").alias("st"), F.first("rank").alias("sr"))
    first = first.select(*group, "st", "sr", turn_tokens(F.col("st")).alias("s"))
    rows = rows.withColumn("rank", rank).join(first, group, "left")
    kept = F.coalesce(F.when(budget - history - F.col("s") >= budget // 8, F.col("s")), F.lit(0))
    rows = rows.withColumn("kept", kept).withColumn("half", F.expr(f"({budget - history} - kept) DIV 2")).withColumn("big", (F.col("n") > F.col("half")).cast("long"))
    rows = rows.repartition(*group, "run")  # a long conversation is dealt out by its runs

    inside = Window.partitionBy(*group, "run").orderBy("t", "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("n").over(so_far).alias("to"), F.sum("big").over(so_far).alias("bigs"), F.row_number().over(inside).alias("place"), F.lead(F.struct("n", "big")).over(inside).alias("after"))
    rows = rows.withColumn("a", F.expr("(to - n) DIV half")).withColumn("b", 2 * F.col("bigs") - F.col("big"))
    span = Window.partitionBy(*group, "run", "a", "b")
    rows = rows.select("*", F.min("place").over(span).alias("start"), F.max(F.struct("place", "to", "after")).over(span).alias("end"))

    system = F.coalesce((F.col("rank") == F.col("sr")) & (F.col("text") == F.col("st")) & (F.col("place") == 1), F.lit(False))
    fits = ~(F.col("end.after.big") == 1) | (F.col("end.after.n") + history + F.col("kept") <= budget)
    again = F.col("end.after").isNotNull() & fits & ~system & (F.col("end.to") - F.col("to") + F.col("n") <= history)

    # 2: a turn of the window itself; 1: history
    def place(kind: int, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"))

    own, nxt = place(2, F.col("start")), place(1, F.col("end.place") + 1)
    turn_of = F.struct(F.col("at.kind").alias("kind"), "place", "role", "text", "n")
    shown = rows.select("c", *group, "run", system.alias("own_system"), F.when(F.col("kept") > 0, F.struct("st", "s")).alias("lead"), "place", "role", "text", "n", F.explode(F.when(again, F.array(own, nxt)).otherwise(F.array(own))).alias("at"))
    grouped = shown.groupBy(*group, "run", F.col("at.start").alias("start")).agg(F.first("c").alias("c"), F.sort_array(F.collect_list(turn_of)).alias("turns"), F.first("lead").alias("lead"), F.max("own_system").alias("own_system"), F.sum("n").alias("n"))
    said = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("place"), F.lit("system").alias("role"), F.col("lead.st").alias("text"), F.col("lead.s").alias("n"))
    led = F.col("lead").isNotNull() & ~F.col("own_system") & (F.col("n") + F.col("lead.s") <= budget)
    everything = F.when(led, F.concat(F.array(said), F.col("turns"))).otherwise(F.col("turns"))
    grouped = grouped.select("c", F.struct("run", "start").alias("window"), everything.alias("turns"), F.when(led, F.col("n") + F.col("lead.s")).otherwise(F.col("n")).alias("tokens"))

    def written(x: Column) -> Column:
        own = x["role"] == target
        head = F.concat(F.when(own, F.lit(BEGIN)).otherwise(F.lit(BEGIN + ASK)), _role_out(x["role"]), F.lit("\n"))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), F.when(own, F.lit(END)).otherwise(F.lit(ASKED + END)).alias("tail"), (own & (x["kind"] == 2)).alias("target"))

    parts = grouped.select("c", "window", F.size(F.filter("turns", lambda x: x["kind"] < 2)).alias("repeated"), F.transform("turns", written).alias("parts"), "tokens")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        stop = start + F.length(x["body"])
        return F.struct((stop + F.length(x["tail"])).alias("at"), F.when(x["target"], F.concat(acc["loss"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(acc["loss"]).alias("loss"))

    empty = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT>>)").alias("loss"))
    return parts.select(
        F.col("c").alias(conv),
        "window",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("text"),
        F.aggregate("parts", empty, step, lambda acc: acc["loss"]).alias("loss"),
        "repeated",
        "tokens",
    )


def read_back(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """(conv, window, turns, targets): the turns (role, text) that each window shows for the first time, and its target texts, read from the formatted text alone."""

    def parsed(piece: Column) -> Column:
        line = F.replace(F.replace(F.replace(piece, F.lit(BEGIN)), F.lit(ASKED)), F.lit(ASK))
        cut = F.position(F.lit("\n"), line)
        return F.struct(_role_in(F.substring(line, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(line, cut + 1, F.length(line))).alias("text"))

    pieces = F.split(F.col("text"), END)
    fresh = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    return formatted.select(conv, "window", F.transform(fresh, parsed).alias("turns"), F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"]))).alias("targets"), F.length("text").alias("chars"))
