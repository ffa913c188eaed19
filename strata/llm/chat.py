"""Chat formatting from an event log, in DataFrame functions alone.

The log (conv_id, message, turn, seq, kind, role, body) is folded per message in the order of seq:
``open`` gives turn and role, ``delta`` appends its body, ``edit`` replaces the text by its body,
``regenerate`` throws the text away, ``delete`` removes the message. The final messages of a
conversation are rendered in the order of turn (then role, SHA-256 of the text, message id).

Template: ``<|turn|>role<|text|>text<|end|>\\n`` for each turn. Control strings inside roles and
texts get a backslash after their first character, backslashes are doubled, so no control string is
left inside and the reading is exact. The loss mask has one entry per turn: the characters of the turn,
how many of them precede the loss, and how many are under it (all of an assistant's text, else 0).

A hot conversation is folded message by message on many tasks; only its finished messages meet, as the
rendered conversation is one string (so bounded by the size of a row).

Defined results: null texts, roles and bodies are empty; events with equal seq go by kind, role and body;
events without an ``open`` make a message with null turn and empty role; null turns sort first, null
conversation ids are one conversation; repeated rows are turns of their own; an empty log gives no rows;
further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What starts this template's marks, and the control strings of other common templates; fixed values.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
LOSS_ROLE = "assistant"
#: More than any array has.
LONG = 1 << 30


def escape(x: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL,
                  F.replace(x, F.lit("\\"), F.lit("\\\\")))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, message, turn, role, text."""
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"),
                                               F.coalesce("body", F.lit("")).alias("body"), "turn")))
    messages = events.groupBy("conv_id", "message").agg(log.alias("log"))
    places = F.sequence(F.lit(0), F.size("log") - 1)
    resets = F.filter(places, lambda i: F.get("log", i)["kind"].isin("edit", "regenerate"))
    opens = F.filter("log", lambda e: e["kind"] == "open")
    live = F.slice("log", F.coalesce(F.array_max("resets"), F.lit(0)) + 1, F.size("log"))
    kept = F.filter(live, lambda e: e["kind"].isin("delta", "edit"))
    return (messages.where(~F.exists("log", lambda e: e["kind"].eqNullSafe("delete"))).withColumn("resets", resets)
            .select("conv_id", "message", F.element_at(F.filter(opens, lambda e: F.lit(True)), -1).alias("open"),
                    F.array_join(F.transform(kept, lambda e: e["body"]), "").alias("text"))
            .select("conv_id", "message", F.col("open.turn").alias("turn"),
                    F.coalesce("open.role", F.lit("")).alias("role"), "text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask: array of (chars, before, loss) per turn."""
    order = F.struct("turn", "role", F.sha2("text", 256).alias("digest"), "message", "text")
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"),
        t["role"].alias("role")))
    whole = F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n")))
    mask = F.transform("parts", lambda p: F.struct(
        (F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).cast("long").alias("chars"),
        F.length(p["head"]).cast("long").alias("before"),
        F.when(p["role"] == LOSS_ROLE, F.length(p["body"])).otherwise(0).cast("long").alias("loss")))
    return (messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("turns"))
            .select("conv_id", parts.alias("parts"))
            .select("conv_id", F.array_join(whole, "").alias("formatted"), mask.alias("loss_mask")))


def pieces(formatted: str) -> Column:
    """The rendered turns, without their opening mark."""
    return F.slice(F.split(F.col(formatted), r"<\|turn\|>"), 2, LONG)


def read_back(formatted: str = "formatted") -> Column:
    """Array of (role, text) from a rendered conversation."""
    return F.transform(pieces(formatted), lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def loss_texts(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    """The unescaped texts under the loss mask, in order."""
    under = F.zip_with(pieces(formatted), mask, lambda p, m: F.when(
        m["loss"] > 0, F.substring(p, (m["before"] - len(TURN) + 1).cast("int"), m["loss"].cast("int"))))
    return F.transform(F.filter(under, lambda x: x.isNotNull()), unescape)


CHUNK = 160


def as_events(conversations: DataFrame) -> DataFrame:
    """The log that leads to the given turns (conv_id, turn, role, text): each streamed in chunks, after a
    draft that is regenerated (assistants) or edited (others)."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def event(seq, kind, body):
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), body.alias("body"))

    first = F.coalesce(F.get("chunks", F.lit(0)), F.lit(""))
    drafted = F.array(event(F.lit(0), "open", F.lit("")), event(F.lit(1), "delta", F.concat(F.lit("draft "), first)))
    again = F.array(event(F.lit(2), "regenerate", F.lit("")), event(F.lit(3), "delta", first))
    edited = F.array(event(F.lit(2), "edit", first))
    rest = F.transform(F.slice("chunks", 2, LONG), lambda c, i: event(i + 4, "delta", c))
    events = F.concat(drafted, F.when(F.col("role") == LOSS_ROLE, again).otherwise(edited), rest)
    rows = conversations.select("conv_id", F.monotonically_increasing_id().alias("message"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), chunks.alias("chunks"))
    return rows.select("conv_id", "message", "turn", "role", F.explode(events).alias("e")).select(
        "conv_id", "message", "turn", "role", "e.seq", "e.kind", "e.body")
