"""Chat logs to training text: event-sourced reconstruction, rendering and a loss mask.

DataFrame functions only. A log holds events of messages; folding them gives
each message's final role and text, and the messages of a conversation in
order give one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template's marks. `<` never stands in an escaped text, so marks can't be forged.
OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): every message's final state.

    events: (conv_id, message, seq, kind, role, text), message and seq being of
    any type that sorts. Kinds: `message` and `edit` set the text, `regenerate`
    empties it, `delta` appends; any other kind is ignored. Null text is empty;
    the role is that of the last event that has one, else empty. Events of a
    message with equal seq fold in the order of kind, then text; an event that a log
    repeats is folded as often. Null conversations and messages are groups of
    their own. Texts of any length are folded whole. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    known = events.where(F.col("kind").isin("message", "edit", "regenerate", "delta"))
    reset = F.when(F.col("kind") != "delta", F.struct("seq", "kind", text.alias("text")))
    live = known.withColumn("reset", F.max(reset).over(W.partitionBy("conv_id", "message")))
    later = (F.col("kind") == "delta") & (F.col("reset").isNull() | (F.col("seq") >= F.col("reset.seq")))
    return (
        live.groupBy("conv_id", "message")
        .agg(
            F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", text))), F.lit("")).alias("role"),
            F.max("reset").alias("reset"),
            F.array_sort(F.collect_list(F.when(later, F.struct("seq", text.alias("part"))))).alias("deltas"),
        )
        .select(
            "conv_id",
            "message",
            "role",
            F.concat(
                F.when(F.col("reset.kind") == "regenerate", "").otherwise(F.coalesce("reset.text", F.lit(""))),
                F.array_join(F.transform("deltas", lambda d: d["part"]), ""),
            ).alias("text"),
        )
    )


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss): each conversation as one text.

    messages: (conv_id, message, role, text), in the order of message. loss: an
    array of the assistant's texts in the formatted text as (turn, within,
    start, length): its number from 1, its place in the turn's rendering and in
    the whole, its length, in code points.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    order = W.partitionBy("conv_id").orderBy("message")
    turns = (
        messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body"))
        .withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
        .withColumn("turn", F.row_number().over(order))
        .withColumn("at", F.sum(F.col("size").cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    )
    span = F.when(
        F.col("role") == "assistant",
        F.struct(
            "turn",
            F.length("head").alias("within"),
            (F.col("at") + F.length("head")).alias("start"),
            F.length("body").cast("long").alias("length"),
        ),
    )
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("piece")))), lambda x: x["piece"]
            ),
            "",
        ).alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) from formatted texts and their loss spans: roles and texts, and the texts under the mask."""
    pieces = F.slice(F.split("formatted", CLOSE, -1), F.lit(1), F.size(F.split("formatted", CLOSE, -1)) - 1)
    parsed = chats.withColumn("pieces", pieces)
    turn = lambda p: F.struct(
        unescaped(F.substring(F.split(p, MIDDLE, -1)[0], F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
        unescaped(F.split(p, MIDDLE, -1)[1]).alias("text"),
    )
    return parsed.select(
        "conv_id",
        F.transform("pieces", turn).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substring(F.element_at("pieces", s["turn"]), s["within"] + 1, s["length"].cast("int")))).alias("loss_texts"),
        F.length("formatted").alias("formatted_chars"),
    )


#: Pieces in which an assistant's text is streamed.
PIECES = 4


def turn_events(rows: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as the log that such a chat leaves behind.

    An assistant's turn begins as an outdated message, is regenerated and
    streamed in deltas; any other turn begins as a draft that an edit replaces.
    Null roles and texts are empty. Rows that agree in everything are as many
    messages. Within a turn, messages sort by role, then by a digest of the text. The
    log is dealt by conversation, so folding and rendering need no other shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    size = F.ceil(F.length("text") / PIECES).cast("int")
    event = lambda seq, kind, said: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    old = F.concat(F.lit("old: "), F.left("text", F.lit(20)))
    streamed = [event(2 + i, "delta", F.substring("text", F.lit(i) * size + 1, size)) for i in range(PIECES)]
    assistant = F.array(event(0, "message", old), event(1, "regenerate", F.lit(None).cast("string")), *streamed)
    other = F.array(event(0, "message", old), event(1, "edit", F.col("text")))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .repartition("conv_id")
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("event", F.explode(F.when(F.col("role") == "assistant", assistant).otherwise(other)))
        .select(
            "conv_id",
            F.struct("turn", "role", F.md5("text").alias("digest"), "copy").alias("message"),
            "event.seq",
            "event.kind",
            "role",
            F.col("event.text").alias("text"),
        )
    )
