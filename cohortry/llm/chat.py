"""Chat formatting from an event log, with DataFrame functions only.

A log holds events of messages: ``message`` opens one, ``delta`` appends streamed text, ``edit`` and ``regenerate`` replace
what was there, ``delete`` removes it. Events are partitioned by conversation and message, what the last replacing event has
made obsolete is filtered out, and the rest is folded in sequence to the final message. Messages are escaped, rendered with
turn marks, placed by a running length, and joined to one text per conversation with its loss mask.

Template of a turn: ``### role:`` newline text ``</turn>`` newline. In texts and roles, a backslash is written ``\\b``, ``#`` is
``\\h`` and ``<`` is ``\\l``; in roles, ``:`` is ``\\c`` and a newline ``\\n``. So no mark can occur inside a turn, and replacing the
pairs again restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
LOSS_ROLE = "assistant"
REPLACING = ("message", "edit", "regenerate", "delete")
DRAFT_CHARS = 16  # of a text, in the drafts of a log made from a table
IN_TEXT = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
IN_ROLE = [*IN_TEXT, (":", "\\c"), ("\n", "\\n")]


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs: list[tuple[str, str]] = IN_TEXT) -> Column:
    return _swap(text, pairs)


def unescape(text: Column, pairs: list[tuple[str, str]] = IN_TEXT) -> Column:
    """Undo ``escape``. The backslash comes last, so that no pair arises from what was restored."""
    return _swap(text, [(new, old) for old, new in reversed(pairs)])


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, first_seq, role, text`` of a log ``conv_id, message, seq, kind, role, text``.

    Events count in order of ``seq`` (any orderable type, nulls first); of one seq, replacing events come before deltas, and each kind in
    order of its text. Events equal in message, seq, kind and text are one event that was delivered again. A null kind opens a
    message; null texts are empty; the role is the last known one, else empty. A message whose last replacing event deletes
    it, and has no deltas after it, is gone. Null conversations and messages are groups of their own.
    """
    group = Window.partitionBy("conv_id", "message")
    kind = F.coalesce("kind", F.lit("message"))
    replaces = kind.isin(*REPLACING)
    spoken = F.when(kind == "delete", F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    event = F.struct("seq", F.when(replaces, 0).otherwise(1).alias("rank"), spoken.alias("text"), kind.alias("kind"))
    read = events.select("conv_id", "message", "seq", "role", event.alias("event"), replaces.alias("replaces"))
    rows = read.select(
        "*",
        F.max(F.when(F.col("replaces"), F.col("event"))).over(group).alias("_last"),
        F.min(F.struct("seq")).over(group).alias("_first"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(group).alias("_role"),
    )
    alive = rows.filter(F.col("_last").isNull() | (F.col("event") >= F.col("_last")))
    return (
        alive.groupBy("conv_id", "message")
        .agg(
            F.first("_first.seq").alias("first_seq"),
            F.coalesce(F.first("_role.role"), F.lit("")).alias("role"),
            F.array_join(F.sort_array(F.collect_set("event"))["text"], "").alias("text"),
            F.bool_and(F.col("event.kind") == "delete").alias("_gone"),
        )
        .filter("not _gone")
        .drop("_gone")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask``.

    ``mask`` has one entry per turn: ``turn_start, loss_start, loss_end``, code point offsets into ``formatted``; the loss covers
    the texts of the assistant, other turns have an empty span. A conversation is one string, so it must fit a row.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), IN_ROLE), F.lit(MIDDLE))
    body = escape(F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("first_seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    turns = messages.select("conv_id", "first_seq", "message", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    loss = F.col("start") + F.length("head")
    entry = F.struct(
        F.col("start").alias("turn_start"),
        loss.alias("loss_start"),
        (loss + F.when(F.col("role") == LOSS_ROLE, F.length("body")).otherwise(F.lit(0))).alias("loss_end"),
        F.concat("head", "body", F.lit(CLOSE)).alias("turn"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("t.turn"), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["turn_start"], t["loss_start"], t["loss_end"])).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss_text``: roles and texts parsed from the formatted text, and the text under the mask."""
    split = F.split("formatted", CLOSE, -1)
    pieces = formatted.withColumn("pieces", F.slice(split, 1, F.size(split) - 1))

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), MIDDLE, 1)
        text = F.substr(piece, F.length(role) + len(OPEN) + len(MIDDLE) + 1)
        return F.struct(unescape(role, IN_ROLE).alias("role"), unescape(text).alias("text"))

    def masked(piece: Column, m: Column) -> Column:
        return unescape(F.substr(piece, (m["loss_start"] - m["turn_start"] + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int")))

    return pieces.select(
        "conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.array_join(F.zip_with("pieces", "mask", masked), "").alias("loss_text")
    )


def table_events(conversations: DataFrame) -> DataFrame:
    """A conversation table (conv_id, turn, role, text) as the event log of how it might have come about.

    An answer of the assistant is opened with a first attempt and a delta, regenerated, and completed by a delta; its opening is
    delivered twice. Any other row is opened as a draft and edited to its text, and goes with a second message that is opened,
    streamed to and deleted. Rows of one turn are messages of their own, in order of role and text; equal rows too.
    """
    same_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(same_turn))
    half = (F.length("text") / 2).cast("int")
    draft = F.substr("text", F.lit(1), F.lit(DRAFT_CHARS))

    def event(part: int, kind: str, text: Column, dropped: bool = False) -> Column:
        place = -F.col("copy") if dropped else F.col("copy")
        return F.struct(
            F.struct(F.col("turn"), place.alias("copy")).alias("message"), F.lit(part).alias("part"), F.lit(kind).alias("kind"),
            (F.col("role") if kind == "message" else F.lit(None).cast("string")).alias("role"), text.alias("text"),
        )

    nothing = F.lit(None).cast("string")
    answer = [
        event(0, "message", draft), event(0, "message", draft), event(1, "delta", F.lit(" and so on")), event(2, "regenerate", F.substr("text", F.lit(1), half)),
        event(3, "delta", F.substr("text", half + 1)),
    ]
    other = [
        event(0, "message", draft), event(1, "edit", F.col("text")), event(0, "message", F.lit("never"), True), event(1, "delta", F.lit(" mind"), True),
        event(2, "delete", nothing, True),
    ]
    events = F.when(F.col("role") == LOSS_ROLE, F.array(*answer)).otherwise(F.array(*other))
    return rows.select("conv_id", F.inline(events)).select(
        "conv_id", "message", F.struct("message.turn", "message.copy", "part").alias("seq"), "kind", "role", "text"
    )


def chat_digests(conversations: DataFrame) -> DataFrame:
    """The conversations formatted and read back, as digests; one more conversation (-7) holds the template's own marks.

    Null texts and roles are empty; a null conversation id is a conversation; null turns come first. Other columns are not read.
    """
    spark = conversations.sparkSession
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(own)
    read = read_back(render(fold_events(table_events(rows))))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_size(text: str, marks: str) -> str:
    extra = " + ".join(f"(length({text}) - length(replace({text}, {m}, '')))" for m in marks.split())
    return f"(length({text}) + {extra})"


SQL = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
sized AS (SELECT *, {len(OPEN) + len(MIDDLE) + len(CLOSE)} + {_sql_size('role', "chr(92) chr(35) chr(60) chr(58) chr(10)")}
  + {_sql_size('text', "chr(92) chr(35) chr(60)")} AS size FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
