"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn becomes ``<s>role`` newline ``[INST]text[/INST]</s>`` newline. These control strings
inside roles and texts are escaped by a backslash behind their first character, after
backslashes have been doubled, which unescaping reverses exactly.

Each turn counts as its words and marks plus ``TURN_TOKENS``. Prefix sums over a
conversation cut it into cells of ``budget`` minus history and system room: turns that lie in
one cell form a window, a turn across a cell border forms one of its own. So every window keeps
the budget unless one turn alone exceeds it, and no turn is ever cut. A window opens with the
system turn (if the conversation starts with one) and at most ``history_turns`` earlier turns
within ``history`` tokens, marked as repeated. The loss mask covers assistant texts of new
turns only, so each assistant text is a target once.

Prefix sums are taken in chunks of the turn number first and then over the chunks, and what a
window repeats is looked up by turn position, so no conversation has to fit into one task
until its digest is asked for.

Defined results: null texts and roles count as empty. A null conv_id is a conversation of
its own; null turn numbers come first. Turns of equal number are ordered by role and text;
repeated rows are turns of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pixelstrata.llm.tables import stored

BUDGET = 1024
HISTORY = 192
SYSTEM = 128
HISTORY_TURNS = 2
TURN_TOKENS = 8
CHUNK = 256
CONTROL = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + CONTROL, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def framed(role: Column, text: Column) -> Column:
    """A formatted turn, from escaped parts."""
    return F.concat(F.lit("<s>"), role, F.lit("\n" + OPEN), text, F.lit(CLOSE + END + "\n"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, conv_id, role, text (escaped), tokens, at (position), upto (tokens of earlier turns)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    tokens = F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + TURN_TOKENS
    rows = conversations.select(conv.alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"), tokens.cast("bigint").alias("tokens"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    sums = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    inside = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("k", F.row_number().over(inside) - 1)
    rows = rows.withColumn("t", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    rows = rows.join(sums, ["conv", "chunk"])
    return rows.select("conv", "conv_id", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), "tokens", (F.col("n0") + F.col("k")).alias("at"), (F.col("t0") + F.col("t")).alias("upto"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conv, conv_id, first (position of the first new turn), repeated (turns before it), formatted, loss, tokens.

    ``loss`` holds the spans [start, end) of ``formatted``, in characters, that are targets.
    """
    room = max(1, budget - history - system)
    turns = stored(numbered(conversations), "chat-turns")
    cells = turns.withColumn("cell", F.struct(F.floor(F.col("upto") / room).alias("a"), F.floor((F.col("upto") + F.col("tokens") - 1) / room).alias("b")))
    starts = cells.groupBy("conv", "cell").agg(F.min("at").alias("first"), F.min("upto").alias("upto"))
    new = cells.join(starts.drop("upto"), ["conv", "cell"]).select("conv", "conv_id", "first", "at", "role", "text", "tokens", F.lit(False).alias("again"))
    asked = F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.sequence(F.greatest(F.col("first") - history_turns, F.lit(0)), F.col("first") - 1)))
    wanted = starts.where("first > 0").select("conv", "first", F.col("upto").alias("from"), F.explode(asked).alias("at"))
    near = (F.col("at") >= F.col("first") - history_turns) & (F.col("from") - F.col("upto") <= history)
    head = (F.col("at") == 0) & (F.col("role") == "system") & (F.col("tokens") <= system)
    old = wanted.join(turns, ["conv", "at"]).where(near | head).select("conv", "conv_id", "first", "at", "role", "text", "tokens", F.lit(True).alias("again"))
    group = new.unionByName(old).groupBy("conv", "first")
    made = group.agg(F.first("conv_id").alias("conv_id"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("at", "again", "role", "text"))).alias("parts"))
    frames = F.transform("parts", lambda p: framed(p["role"], p["text"]))
    made = made.withColumn("frames", frames).withColumn("sizes", F.transform("frames", lambda f: F.length(f).cast("bigint")))
    upto = F.aggregate("sizes", F.array(F.lit(0).cast("bigint")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    made = made.withColumn("starts", upto)

    def span(p: Column, k: Column) -> Column:
        start = F.get("starts", k) + F.length(p["role"]) + len("<s>\n" + OPEN)
        new_target = (p["role"] == "assistant") & ~p["again"]
        return F.when(new_target, F.struct(start.alias("start"), (start + F.length(p["text"])).alias("end")))

    loss = F.filter(F.transform("parts", span), lambda x: x.isNotNull())
    repeated = F.size(F.filter("parts", lambda p: p["again"]))
    return made.select("conv", "conv_id", "first", repeated.alias("repeated"), F.array_join("frames", "").alias("formatted"), loss.alias("loss"), "tokens")


def turns_of(formatted: Column) -> Column:
    """Array of (role, text), unescaped, of a formatted window."""
    pieces = F.filter(F.split(formatted, END + "\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.position(F.lit("\n" + OPEN), p)
        role = F.substring(p, F.lit(4), at - 4)
        text = F.substring(p, at + len("\n" + OPEN), F.length(p) - at - len("\n" + OPEN) - len(CLOSE) + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows of each conversation."""
    turns = F.slice(turns_of(F.col("formatted")), F.col("repeated") + 1, F.size(F.split("formatted", END + "\n")))
    spoken = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    targets = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = made.select(
        "conv", "conv_id", "first", F.length("formatted").cast("bigint").alias("chars"), F.size(spoken).cast("bigint").alias("n"),
        F.array_join(spoken, "").alias("spoken"), F.array_join(targets, "").alias("targets"),
    )
    group = rows.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
        F.array_sort(F.collect_list(F.struct("first", "spoken", "targets"))).alias("w"),
    )
    spoken, targets = F.array_join("w.spoken", ""), F.array_join("w.targets", "")
    return group.select(
        "conv_id", "n_turns", F.sha2(F.encode(spoken, "UTF-8"), 256).alias("turns_sha256"), F.length(targets).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(targets, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
