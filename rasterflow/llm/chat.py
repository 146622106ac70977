"""Chat formatting from event logs.

A log has one row for each event of a conversation: ``(conv_id, seq, kind, msg, role,
text)``. ``msg`` numbers the messages of a conversation; kinds are

* ``start``: message ``msg`` is begun by ``role`` (its text is the first delta),
* ``delta``: more text of message ``msg``,
* ``edit``: the text of ``msg`` is replaced; later messages up to here are void,
* ``regenerate``: the text of ``msg`` is dropped and streamed again (its text is the first
  delta of the new version); later messages up to here are void.

So an event counts if no later event replaced its message's text, and no later edit or
regeneration of an earlier message made its message void. That needs, for each message,
the last replacement of its own and of all messages before it: an aggregation for each
message and a running maximum, over ranges of messages and then within each, so no task
has all of a long conversation's messages. Events are gathered message by message; only
final messages meet in a conversation, which must fit in a row as its rendered text does.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings. A turn is TURN + role + ROLE + text + END.
TURN, ROLE, END = "<s>[INST] ", " [/INST] ", " </s>\n"
#: A backslash follows each of these where it is text, so no control string can occur in a text.
CONTROL = r"[<\[\\]"
#: Messages of a conversation whose resets are looked through at once.
RANGE = 4096


def escape(text: Column) -> Column:
    """Text in which no control string occurs; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({CONTROL})\\", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, msg, role, text)`` of the messages that stand at the end of a log.

    Null kinds are deltas, null texts empty; events with equal ``seq`` are taken in order
    of kind and text. The role is that of the latest event that names one; without any it
    is empty. Events without ``conv_id`` form one conversation, events without ``msg`` or
    ``seq`` come before all others. A message whose every event was made void is gone.
    """
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    rows = events.select("conv_id", F.coalesce(F.col("msg").cast("long"), F.lit(-1)).alias("msg"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    # the last reset of all messages before: first over ranges of messages, then within a range
    messages = rows.groupBy("conv_id", "msg").agg(resets.alias("own")).withColumn("range", F.floor(F.col("msg") / RANGE))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = messages.groupBy("conv_id", "range").agg(F.max("own").alias("last")).select(F.col("conv_id").alias("_r"), F.col("range").alias("_n"), F.max("last").over(earlier).alias("ahead"))
    before = Window.partitionBy("conv_id", "range").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    inside = messages.withColumn("near", F.max("own").over(before)).join(ranges, F.col("conv_id").eqNullSafe(F.col("_r")) & (F.col("range") == F.col("_n")))
    cuts = inside.select(F.col("conv_id").alias("_c"), F.col("msg").alias("_m"), "own", F.greatest("near", "ahead").alias("cut"))
    live = rows.join(cuts, rows.conv_id.eqNullSafe(F.col("_c")) & (rows.msg == F.col("_m")))
    replaces = F.col("kind").isin("edit", "regenerate")
    counts = (F.col("cut").isNull() | (F.col("seq") > F.col("cut"))) & (F.col("own").isNull() | (F.col("seq") > F.col("own")) | ((F.col("seq") == F.col("own")) & replaces))
    # deltas after an edit go on from its text
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role")))
    parts = F.array_sort(F.collect_list(F.when(counts, F.struct("seq", "kind", "text"))))
    # a role may come from an event whose text was replaced, but not from a void one
    known = live.where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    folded = known.groupBy("conv_id", "msg").agg(role.alias("role"), parts.alias("parts"))
    return folded.where(F.size("parts") > 0).select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, spans)``: conversations as text, turns in order of ``msg``.

    ``spans`` are the places of assistant texts, escaped as they stand: code point offsets
    ``(start, end)``, the loss mask. Messages with equal numbers stand in order of role and
    text.
    """
    turn = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE))
    rows = messages.select("conv_id", "msg", "role", F.coalesce("text", F.lit("")).alias("text"), turn.alias("head"), escape(F.col("text")).alias("body"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "role", "text", "head", "body"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        found = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(END)).alias("at"), F.concat(state["spans"], found).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return turns.select("conv_id", formatted.alias("formatted"), F.aggregate("turns", begin, add)["spans"].alias("spans"))


def parse(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``turns`` (role and text, unescaped) and ``loss_text`` read back from ``formatted``."""
    whole = F.filter(F.split("formatted", END.replace("[", r"\[")), lambda t: t != "")
    cut = lambda t: F.split(F.substring(t, len(TURN) + 1, F.length(t)), ROLE.replace("[", r"\["), 2)
    turns = F.transform(whole, lambda t: F.struct(unescape(cut(t)[0]).alias("role"), unescape(cut(t)[1]).alias("text")))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return rendered.withColumns({"turns": turns, "loss_text": loss})


def format_log(events: DataFrame) -> DataFrame:
    """An event log as training texts: ``(conv_id, formatted, spans)``.

    An empty log gives an empty result; other columns are not read.
    """
    return render(fold_events(events))


def streamed_log(conversations: DataFrame, piece: int = 200) -> DataFrame:
    """Finished conversations, a row for each turn, as the log of a service that streamed them.

    Each message is begun with a draft and followed by the start of a later message; then
    the draft is edited (odd messages) or regenerated (even ones), which voids that later
    message, and the text is streamed in deltas of ``piece`` code points. Folding the log
    gives back the turns: null roles and texts as empty ones, rows with equal turns as
    messages of their own in order of role and text. An empty table gives an empty log.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), place.alias("msg"))
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / piece)).cast("int")
    seq = lambda k: F.shiftleft("msg", 32) + k
    event = lambda k, kind, msg, role, text: F.struct(seq(k).alias("seq"), kind.alias("kind"), msg.alias("msg"), role.cast("string").alias("role"), text.alias("text"))
    part = lambda i: F.substring("text", (i - 1) * piece + 1, F.lit(piece))
    own, none = F.col("msg"), F.lit(None)
    begun = F.array(
        event(F.lit(0).cast("long"), F.lit("start"), own, F.col("role"), F.concat(F.lit("draft "), F.substring("text", 1, 20))),
        event(F.lit(1).cast("long"), F.lit("start"), own + 1, F.lit("assistant"), F.lit("void")),
        event(F.lit(2).cast("long"), F.when(own % 2 == 1, "edit").otherwise("regenerate"), own, none, part(F.lit(1))),
    )
    deltas = F.when(count > 1, F.transform(F.sequence(F.lit(2), F.greatest(count, F.lit(2))), lambda i: event((i + 1).cast("long"), F.lit("delta"), own, none, part(i)))).otherwise(F.slice(begun, 1, 0))
    return rows.select("conv_id", F.explode(F.concat(begun, deltas)).alias("e")).select("conv_id", "e.*")


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """Finished conversations, a row for each turn, as an event log.

    Each row starts and streams one message; rows with equal turns are messages of their
    own, in order of role and text.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return conversations.select("conv_id", place.alias("seq"), F.lit("start").alias("kind"), place.alias("msg"), "role", "text")
