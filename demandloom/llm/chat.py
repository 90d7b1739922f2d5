"""Chat formatting from event logs, with DataFrame functions only.

A log holds events (conv_id, seq, message, kind, role, text): ``open`` starts a message with a role, ``delta`` appends
streamed text, ``edit`` replaces the message's text, ``regenerate`` throws it away. Sorted by sequence they are folded
into the message's final text: what follows its last edit or regeneration, that edit's text included. Messages of a
conversation are ordered by their first event. Events are gathered per message first, then messages per conversation.

The template: ``<|im_start|>role`` newline text ``<|im_end|>`` newline. A control string inside a text gets a tilde after its first
character (one more if it has some already), which reading back takes away again; nothing else of a text changes. The
control strings of the ``[INST]`` family are escaped too. In roles percent signs and newlines are written as %25 and %0A.

Null texts and roles count as empty, rows of one turn are ordered by role and text, rows without a conv_id form a
conversation of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 16
PIECE_CHARS = 400
SPACING = 64
# Control strings of two common chat templates, without their first character.
_CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
_PLAIN, _ESCAPED = rf"([<\[])(~*){_CONTROL}", rf"([<\[])~(~*){_CONTROL}"
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def event_log(turns: DataFrame) -> DataFrame:
    """A log that leads to ``turns`` (conv_id, turn, role, text), as a chat service would have written it.

    Assistant texts are streamed in pieces after a draft that was regenerated; others were sent unfinished, then edited.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("message", F.row_number().over(order).cast("long"))
    length = F.char_length("text")
    step = F.greatest(F.lit(PIECE_CHARS), F.ceil(length / PIECES).cast("int"))
    deltas = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(length / step).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(F.lit("delta").alias("kind"), F.substring(F.col("text"), i * step + 1, step).alias("text")),
    )
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.substring(F.col("text"), F.lit(1), F.least(F.lit(40), length))
    streamed = F.concat(F.array(event("open", F.lit("")), event("delta", draft), event("regenerate", F.lit(""))), deltas)
    edited = F.array(event("open", F.lit("")), event("delta", draft), event("edit", F.col("text")))
    return numbered.select(
        "conv_id", "message", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("k", "event")
    ).select(
        "conv_id", (F.col("message") * SPACING + F.col("k")).alias("seq"), "message", "event.kind",
        F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), "event.text",
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, first_seq, role, text) of a log."""
    sorted_events = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    reset = F.array_max(F.transform(F.filter("events", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: e["seq"]))
    last = F.filter(
        "events",
        lambda e: (F.col("reset").isNull() | (e["seq"] >= F.col("reset"))) & e["kind"].isin("delta", "edit"),
    )
    opened = F.filter("events", lambda e: e["kind"] == "open")
    return (
        events.groupBy("conv_id", "message")
        .agg(sorted_events.alias("events"))
        .withColumn("reset", reset)
        .select(
            "conv_id",
            "message",
            F.element_at("events", 1)["seq"].alias("first_seq"),
            F.coalesce(F.try_element_at(opened, F.lit(-1))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(last, lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and its ``segments`` (start, text, loss), which joined give ``formatted``.

    Assistant texts are under the loss mask; marks, roles and all other texts aren't.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "first_seq", "message", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    before = Window.partitionBy("conv_id").orderBy("first_seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("first_seq", "message", "start", "head", "body", "loss"))).alias("turns"))
        .select(
            "conv_id",
            F.flatten(
                F.transform(
                    "turns",
                    lambda t: F.array(
                        F.struct(t["start"].alias("start"), t["head"].alias("text"), F.lit(False).alias("loss")),
                        F.struct((t["start"] + F.char_length(t["head"])).alias("start"), t["body"].alias("text"), t["loss"].alias("loss")),
                        F.struct((t["start"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("start"), F.lit(END).alias("text"), F.lit(False).alias("loss")),
                    ),
                )
            ).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns (role, text) parsed from ``formatted`` and the text under the loss mask, both unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    inner = lambda p: F.substr(p, F.lit(len(START) + 1))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(inner(p), "\n", 1)).alias("role"),
            unescape(F.substr(inner(p), F.char_length(F.substring_index(inner(p), "\n", 1)) + 2)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return rendered.withColumn("turns", turns).withColumn("loss_text", loss)


def format_logs(events: DataFrame) -> DataFrame:
    """conv_id, formatted and segments of every conversation of a log."""
    return render(fold(events))
