r"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events of conversations in the order of a sequence number: a message, a streamed delta that appends to a
turn, an edit that replaces it, a regeneration that empties it for the deltas to come. Folding them gives the final
messages, which one template renders:

    <|turn|>role<|text|>text<|end|>

Inside roles and texts every backslash is doubled and every control string gets a backslash after its first
character; taking the backslash from before any character undoes both. So no control string of the template, nor one
of other common templates, is ever read from a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Openings of control strings, of this template and of other common ones.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from events (conv_id, turn, seq, kind, role, text).

    A message or an edit sets the text, a regeneration empties it, a delta appends; null texts are empty. What precedes a
    turn's last resetting event is void; the role is the first that is not null from then on, else the first known of the turn. Events
    of one turn that share a sequence number fold by kind (delta last), role and text. A kind that is null or unknown counts as a
    message. Each event moves once, to its turn; a conversation's turns need not fit into one task.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")
    reset = kind != "delta"
    order = F.struct("seq", (~reset).alias("late"), kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = events.select("conv_id", "turn", "role", order.alias("e"))
    turns = rows.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("events"))
    places = F.transform("events", lambda e, i: F.when(~e["late"], i).otherwise(-1))
    last = F.array_max(places)
    live = F.when(last >= 0, F.slice("events", last + 1, F.size("events"))).otherwise(F.col("events"))
    turns = turns.withColumn("live", live)
    text = F.array_join(F.transform("live", lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    roles = F.filter(F.transform("live", lambda e: e["role"]), lambda r: r.isNotNull())
    known = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.coalesce(F.try_element_at(roles, F.lit(1)), F.try_element_at(known, F.lit(1)))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one string, its messages in order of turn, role and text.

    loss_spans: for every message of the role ``learn``, its turn's place in the string from 0 and, in code points, where its escaped text
    begins in the rendered turn and how long it is. Null roles and texts are empty; a null conv_id is a conversation
    of its own; an empty table gives an empty one. A conversation is one string, so it must fit into a row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("m"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    piece = lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT), escape(m["text"]), F.lit(END))
    spans = F.transform("m", lambda m, i: F.struct(i.cast("int").alias("turn"), (F.length(escape(m["role"])) + len(TURN) + len(TEXT)).alias("start"), F.length(escape(m["text"])).alias("length"), (m["role"] == learn).alias("own")))
    spans = F.transform(F.filter(spans, lambda s: s["own"]), lambda s: s.dropFields("own"))
    return talks.select("conv_id", F.array_join(F.transform("m", piece), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, turns, loss): the messages (role, text) and the unescaped texts under the loss mask, from the string alone."""
    pieces = F.slice(F.split("formatted", r"(?=<\|turn\|>)"), 1, 1 << 30)
    pieces = F.filter(pieces, lambda p: p != "")
    rendered = rendered.withColumn("pieces", pieces)
    body = lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p) - len(TURN) - len(END)), r"<\|text\|>")
    turns = F.transform("pieces", lambda p: F.struct(unescape(body(p)[0]).alias("role"), unescape(body(p)[1]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("pieces", s["turn"]), s["start"] + 1, s["length"])))
    return rendered.select("conv_id", "formatted", "loss_spans", turns.alias("turns"), loss.alias("loss"))


def format_chats(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Events folded into messages and rendered; see fold() and render()."""
    return render(fold(events), learn)
