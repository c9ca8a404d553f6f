"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows of at most ``budget`` tokens (words, and two for the marks of a
turn). Prefix sums of the turns' tokens choose spans that begin and end at turns: a window takes new
turns while they fit beside ``history`` tokens and the system turn. A window repeats the conversation's first system
turn if that was said before it, and as context the last turns before it, up to ``history`` tokens and to what the
budget leaves. Repeated turns come first and are masked; of the new turns the assistant's texts are under the loss
mask, so each is a target once. Only where the system turn and one new turn exceed the budget together does
a window exceed it, and it holds nothing else.

Turns are counted by (conversation, turn div ``group_turns``), null turns by role and the first 16 characters too,
and the counts' prefix sums deal them into groups of about ``group_turns`` turns, whatever numbers the turns have. A
group also gets the turns of the two groups before it, which hold at least ``group_turns`` turns and thus
``2 * group_turns`` tokens, as context. A group starts a new window, so a conversation of any length is spread over many rows
and tasks. Conversations whose turns all have one quotient need no dealing.

The template is ``<turn>role\\ntext</turn>\\n``. In role and text a backslash is doubled, and a backslash
is put after the ``<`` of a mark (in a role, a newline becomes ``<\\br>``), so marks occur only as marks
and :func:`unescape` gives the text back.

Defined cases: a null text is empty, a null role is the empty role; rows are ordered by turn (nulls
first), then role, then text, and repeated rows are turns of their own; a null conv_id is a
conversation; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

OPEN, CLOSE = "<turn>", "</turn>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE):
        c = F.replace(c, F.lit(mark), F.lit(f"<\\{mark[1:]}"))
    return c


def unescape(c: Column) -> Column:
    for mark in (CLOSE, OPEN):
        c = F.replace(c, F.lit(f"<\\{mark[1:]}"), F.lit(mark))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\br>"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\br>"), F.lit("\n")))


def _groups(rows: DataFrame, group_turns: int) -> DataFrame:
    """``rows`` with ``part``, the group of each turn, and copies (``new`` is false) for up to two later groups."""
    counts = rows.groupBy("conv_id", "place").agg(F.count(F.lit(1)).alias("n"))
    by_conv = Window.partitionBy("conv_id").orderBy("place")
    counts = counts.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("conv_id")) > 1).where("several")
    before = F.sum("n").over(by_conv) - F.col("n")
    counts = counts.withColumn("part", F.floor(before / group_turns).cast("long"))
    # the next two groups that there are
    parts = counts.groupBy("conv_id", "part").agg(F.collect_list("place").alias("places"))
    in_order = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.withColumn("later", F.array_compact(F.array(F.lead("part", 1).over(in_order), F.lead("part", 2).over(in_order))))
    dealt = parts.select(F.col("conv_id").alias("c"), F.explode("places").alias("p"), F.col("part").alias("own_part"), "later")
    known = rows.join(dealt, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    first = F.struct(F.coalesce("own_part", F.lit(0).cast("long")).alias("part"), F.lit(True).alias("new"))
    again = F.transform(F.coalesce("later", F.expr("CAST(array() AS array<long>)")), lambda x: F.struct(x.alias("part"), F.lit(False).alias("new")))
    return known.withColumn("at", F.explode(F.concat(F.array(first), again))).select("conv_id", "at.*", "turn", "role", "body", "tokens")


def windows(conversations: DataFrame, budget: int = 512, history: int = 128, group_turns: int = 256) -> DataFrame:
    """``conv_id, part, window, text, n_context, loss``: one row for each window.

    ``(part, window)`` orders a conversation's windows; ``n_context`` turns at the start of ``text``
    repeat earlier ones; ``loss`` is an array of (start, end) in code points of ``text``.
    """
    if 2 * group_turns < history:
        raise ValueError("group_turns must be at least half of history")
    text = F.coalesce("text", F.lit(""))
    nameless = F.col("turn").isNull()
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.coalesce(F.floor(F.col("turn") / group_turns).cast("long"), F.lit(-(1 << 62))).alias("part"),
            F.when(nameless, F.coalesce("role", F.lit(""))).otherwise("").alias("role"),
            F.when(nameless, F.left(text, F.lit(16))).otherwise("").alias("text"),
        ).alias("place"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("body"),
        (F.regexp_count(text, F.lit(WORD)) + 2).cast("long").alias("tokens"),
    )
    systems = rows.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "role", "body", "tokens")).alias("system"))
    own = _groups(rows, group_turns)
    groups = own.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "tokens", "new"))).alias("turns"))
    s = systems.select(F.col("conv_id").alias("s_id"), "system")
    groups = groups.join(s, F.col("conv_id").eqNullSafe(F.col("s_id")), "left").drop("s_id")
    # the system turn is repeated in windows whose first new turn comes after it in the conversation's order
    key = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["body"].alias("body"))
    system_key = F.when(F.col("system").isNotNull(), key(F.col("system")))
    repeated = lambda t: F.coalesce(system_key < key(t), F.lit(False))
    system_tokens = lambda t: F.when(repeated(t), F.col("system.tokens")).otherwise(F.lit(0).cast("long"))
    # the window of each turn: a new turn starts one when it doesn't fit; context turns have window -1
    start = F.struct(
        F.lit(-1).alias("window"),
        F.lit(0).cast("long").alias("used"),
        F.lit(0).cast("long").alias("room"),
        F.expr("CAST(array() AS array<int>)").alias("of"),
    )

    def place(acc: Column, turn: Column) -> Column:
        # nothing stands before a conversation's first turn
        past = F.when((F.col("part") == 0) & (F.size(acc["of"]) == 0), F.lit(0)).otherwise(F.lit(history))
        fits = (acc["window"] >= 0) & (acc["used"] + turn["tokens"] <= acc["room"])
        window = F.when(fits, acc["window"]).otherwise(acc["window"] + 1).cast("int")
        used = F.when(fits, acc["used"]).otherwise(F.lit(0)) + turn["tokens"]
        room = F.when(fits, acc["room"]).otherwise(F.lit(budget) - past - system_tokens(turn))
        placed = F.struct(
            window.alias("window"), used.cast("long").alias("used"), room.cast("long").alias("room"), F.concat(acc["of"], F.array(window)).alias("of")
        )
        return F.when(turn["new"], placed).otherwise(
            F.struct(
                acc["window"].alias("window"), acc["used"].alias("used"), acc["room"].alias("room"), F.concat(acc["of"], F.array(F.lit(-1))).alias("of")
            )
        )

    sums = F.aggregate(
        "turns", F.expr("array(0L)"), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["tokens"]))
    )
    groups = groups.select("conv_id", "part", "turns", "system", F.aggregate("turns", start, place)["of"].alias("of"), sums.alias("sums"))
    each = groups.withColumn("window", F.explode(F.sequence(F.lit(0), F.array_max("of"))))
    first = (F.array_position("of", F.col("window")) - 1).cast("int")
    last = F.size(F.filter("of", lambda w: w <= F.col("window")))
    each = each.withColumn("first", first).withColumn("last", last)
    opening = F.get("turns", F.col("first"))
    each = each.withColumn("again", repeated(opening))
    # context: the longest run of turns just before the first new one within the history's tokens, the system turn aside
    is_system = lambda t: F.coalesce(key(t) == system_key, F.lit(False))
    used = F.get("sums", F.col("last")) - F.get("sums", F.col("first")) + F.when(F.col("again"), F.col("system.tokens")).otherwise(F.lit(0))
    each = each.withColumn("least", F.get("sums", F.col("first")) - F.least(F.lit(history), F.lit(budget) - used))
    from_turn = F.least(F.size(F.filter("sums", lambda x: x < F.col("least"))), F.col("first"))
    before = F.filter(F.slice("turns", from_turn + 1, F.col("first") - from_turn), lambda t: ~is_system(t))
    fresh = F.slice("turns", F.col("first") + 1, F.col("last") - F.col("first"))
    again = F.when(
        F.col("again"), F.array(F.struct(F.lit("system").alias("role"), F.col("system.body").alias("body")))
    ).otherwise(F.expr("CAST(array() AS array<struct<role: string, body: string>>)"))
    slim = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["body"].alias("body")))
    each = each.select(
        "conv_id", "part", "window", F.concat(again, slim(before)).alias("context"), slim(fresh).alias("fresh")
    ).withColumn("turns", F.concat("context", "fresh"))
    head = lambda t: F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n"))
    shown = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["body"]).alias("body"), t["role"].alias("role")))
    each = each.select("conv_id", "part", "window", F.size("context").alias("n_context"), shown.alias("shown"))
    tail = f"{CLOSE}\n"
    text = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    spans = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("nth"), F.expr("CAST(array() AS array<struct<start: int, end: int>>)").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(tail)).alias("at"),
            (acc["nth"] + 1).alias("nth"),
            F.when(
                (t["role"] == "assistant") & (acc["nth"] >= F.col("n_context")),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(t["head"])).alias("start"),
                            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )["out"]
    return each.select("conv_id", "part", "window", text.alias("text"), "n_context", spans.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """The windows with ``turns`` (role, text) of their new turns and ``targets``, the texts under the mask, all read from the output."""
    raw = F.split("text", f"{CLOSE}\n")
    raw = F.slice(raw, F.col("n_context") + 1, F.greatest(F.size(raw) - 1 - F.col("n_context"), F.lit(0)))
    turns = F.transform(
        raw,
        lambda x: F.struct(
            _unescape_role(F.substr(F.substring_index(x, "\n", 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substr("text", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("*", turns.alias("turns"), targets.alias("targets"))


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows`` read back from :func:`windows`.

    The digests cover a whole conversation, so its text ends up in one row. The masked text travels by
    itself only where it isn't that of the window's assistant turns.
    """
    said_by = lambda turns: F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    target = F.array_join("targets", "")
    back = parse(formatted).select(
        "conv_id", "part", "window", "turns", F.when(target != said_by(F.col("turns")), target).alias("other"), F.length("text").alias("chars")
    )
    whole = back.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("part", "window", "turns", "other"))).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    said = F.array_join(F.flatten(F.transform("parts", lambda x: F.transform(x["turns"], lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))), "")
    loss = F.array_join(F.transform("parts", lambda x: F.coalesce(x["other"], said_by(x["turns"]))), "")
    return whole.select("conv_id", "n_turns", said.alias("said"), loss.alias("loss"), "formatted_chars", "n_windows").select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
