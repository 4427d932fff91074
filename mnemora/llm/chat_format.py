"""Chat formatting from an event log, in DataFrame operations only.

The log holds one row an event: ``conv_id, seq, kind, pos, role, text``.

* ``open``: message ``pos`` of the conversation begins, with ``role``; its text, if any, is the
  first of its content.
* ``delta``: text that is streamed to the end of the message.
* ``edit``: replaces all that the message holds so far; later deltas go behind it.
* ``regenerate``: empties the message (what is streamed next is its new version) and drops
  every later message that was opened before this event.

Events of a conversation are ordered by ``seq``; an event that was delivered twice counts once.
Deltas are folded per message before the messages of a conversation meet, so only final texts do.
Rows without conv_id belong to no common conversation; ``conv_part`` tells theirs apart.

A turn is rendered as ``<turn>### role: text</turn>`` and a newline. Inside role and text each
backslash becomes ``\\b``, ``<`` becomes ``\\l``, ``#`` becomes ``\\h`` and, in roles, ``:``
becomes ``\\c``; so no control string can come from a text, and undoing is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN_OPEN, ROLE_END, TURN_CLOSE = "<turn>### ", ": ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Undo ``escape``. A backslash is always followed by its letter, so the order is free but
    for the backslash itself, which comes last."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, conv_part, pos, role, text``.

    A null text is empty. Events whose seq ties are folded in the order of kind and text; those that
    agree in these and in seq are one event that was delivered again. A message without an ``open``
    takes the role of its first event that has one (or none). Events without conv_id are told apart
    by ``conv_part``, if there is such a column (it may be given for all), else they form one
    conversation. An empty log gives no messages. Other columns are dropped.
    """
    part = F.coalesce("conv_part", F.lit(0).cast("long")) if "conv_part" in events.columns else F.lit(0).cast("long")
    e = events.select("conv_id", part.alias("conv_part"), "pos", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind").isin("open", "edit", "regenerate")
    marks = e.filter(resets).groupBy("conv_id", "conv_part", "pos").agg(
        F.max("seq").alias("since"),
        F.min(F.when(F.col("kind") == "open", F.col("seq"))).alias("opened"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
    )
    # the last regeneration of any earlier message of the conversation
    earlier = F.max("redone").over(W.partitionBy("conv_id", "conv_part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    marks = marks.withColumn("cut", earlier).select(
        F.col("conv_id").alias("_c"), F.col("conv_part").alias("_q"), F.col("pos").alias("_p"), "since", (F.col("cut") > F.col("opened")).alias("_dropped")
    )
    same = e["conv_id"].eqNullSafe(F.col("_c")) & (e["conv_part"] == F.col("_q")) & e["pos"].eqNullSafe(F.col("_p"))
    kept = e.join(marks, same, "left").filter(~F.coalesce(F.col("_dropped"), F.lit(False)))
    live = F.col("since").isNull() | (F.col("seq") >= F.col("since"))
    part = F.when(live & (F.col("kind") != "regenerate"), F.struct("seq", "kind", "text"))
    return kept.groupBy("conv_id", "conv_part", "pos").agg(
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_set(part)), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_mask``: one text a conversation, and the spans
    ``(start, chars)`` of it, in code points, on which loss is taken. Null roles and texts are empty;
    messages whose pos ties (repeated rows too) go by role and text; no messages give no rows."""
    role, text = escape(F.coalesce("role", F.lit("")), role=True), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN_OPEN), role, F.lit(ROLE_END))
    turn = F.struct("pos", F.coalesce("role", F.lit("")).alias("r"), head.alias("head"), text.alias("body"))
    if "conv_part" not in messages.columns:
        messages = messages.withColumn("conv_part", F.lit(0).cast("long"))
    convs = messages.groupBy("conv_id", "conv_part").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    close = len(TURN_CLOSE)
    spans = F.expr(
        f"""aggregate(t, named_struct('at', 0L, 'out', cast(array() as array<struct<start: bigint, chars: bigint>>)),
          (a, x) -> named_struct('at', a.at + char_length(x.head) + char_length(x.body) + {close},
            'out', if(x.r = '{loss_role}', array_append(a.out, named_struct('start', a.at + char_length(x.head), 'chars', cast(char_length(x.body) as bigint))), a.out)),
          a -> a.out)"""
    )
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_CLOSE))), "")
    return convs.select("conv_id", whole.alias("formatted"), spans.alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Add ``turns``, array of (role, text), and ``loss_text``, all text under the mask, both
    read from ``formatted`` and unescaped. Empty text has no turns; null gives nulls."""
    pieces = F.filter(F.split("formatted", TURN_CLOSE), lambda p: p != "")
    rest = lambda p: F.substring(p, F.lit(len(TURN_OPEN) + 1), F.length(p))
    turn = lambda p: F.struct(
        unescape(F.substring_index(rest(p), ROLE_END, 1)).alias("role"),
        unescape(F.substring(rest(p), F.instr(rest(p), ROLE_END) + len(ROLE_END), F.length(p))).alias("text"),
    )
    masked = F.expr("array_join(transform(loss_mask, m -> substring(formatted, cast(m.start + 1 as int), cast(m.chars as int))), '')")
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", unescape(masked))


def conversation_events(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text), as a chat service would
    have left it. Each row opens a message and streams a draft of it. An assistant's draft is followed
    by a message that answers it, and by a regeneration, which drops both; the text is then streamed
    in pieces of ``piece`` code points. Of other roles, an edit replaces the draft by the first
    piece, and the rest is streamed. The last event of each message is delivered twice.

    Rows that share a turn are ordered by role and text; repeated rows are messages of their own.
    Rows without conv_id make a conversation for each different (turn, role, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", text)).otherwise(0).cast("long").alias("conv_part"))
    order = W.partitionBy("conv_id", "conv_part").orderBy("turn", F.coalesce("role", F.lit("")), "text")
    rows = rows.withColumn("at", F.row_number().over(order).cast("long"))
    event = lambda i, kind, body, later=0: f"named_struct('i', {i}, 'later', {later}, 'kind', {kind}, 'text', {body})"
    draft = "reverse(substring(text, 1, 24))"
    start = f"""if(role <=> 'assistant',
        array({event(0, "'open'", "''")}, {event(1, "'delta'", draft)}, {event(2, "'open'", "'and then?'", 1)}, {event(3, "'regenerate'", "''")}, {event(4, "'delta'", "_first")}),
        array({event(0, "'open'", "_first")}, {event(1, "'delta'", draft)}, {event(2, "'delta'", "'...'")}, {event(3, "'edit'", "''")}, {event(4, "'edit'", "_first")}))"""
    rest = f"transform(slice(_pieces, 2, greatest(size(_pieces), 1)), (p, k) -> {event('k + 5', "'delta'", 'p')})"
    # cut in one pass: a substring by place walks from the start of the text
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    parts = rows.withColumn("_pieces", pieces).withColumn("_first", F.substring("text", 1, piece)).withColumn("_start", F.expr(start)).withColumn("_all", F.concat("_start", F.expr(rest)))
    parts = parts.select("conv_id", "conv_part", "at", "role", F.explode(F.concat("_all", F.slice("_all", -1, 1))).alias("e"))
    opened = F.when(F.col("e.kind") == "open", F.when(F.col("e.later") == 1, F.lit("user")).otherwise(F.col("role")))
    return parts.select("conv_id", "conv_part", (F.col("at") * F.lit(1 << 32) + F.col("e.i")).alias("seq"), F.col("e.kind").alias("kind"), (F.col("at") * 2 + F.col("e.later")).alias("pos"), opened.alias("role"), F.col("e.text").alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of conversations, by way of their events."""
    return render(fold_events(conversation_events(conversations)))
