r"""Operator 9: chat formatting by event-sourced reconstruction.  DataFrame functions only.

A log of events (conv_id, message, seq, kind, role, text) is folded to final messages.  Of each message
the last event of kind ``message``, ``edit`` or ``regenerate`` (by seq, then kind and text) starts it
anew with its text; later ``delta`` events append theirs; a null role is the
message's last one before.  Messages in order make the conversation.

A turn is rendered as ``<s>[TAG] text [/TAG]</s>``; TAG is INST for user, SYS for system, ANSWER for
assistant and ROLE:name for others.  In texts and names a backslash is doubled, and control strings are
broken up by one after their first character, so that they occur nowhere but as marks; dropping each
backslash but one that follows another gives the text back.

A message's columns may name it in several parts, so that a log shuffled by some of them is not shuffled again.
Messages are rendered row by row before they are gathered; only the finished strings of a conversation
meet in one row, because that row is the result.

What the loss covers is a mask, spans of characters of the formatted string.

Defined results: null texts and roles are empty; equal orders are settled by role and text; repeated rows
are turns of their own; a null conv_id is a conversation; a very long text is one string of a row; other
columns, whatever their names, are ignored; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import read

TAGS = {"user": "INST", "system": "SYS", "assistant": "ANSWER"}
#: Columns that name a message of the conversations table.
MESSAGE = ("turn", "tie")
STARTS = ("message", "edit", "regenerate")
_CONTROL = r"(?<=<)(?=/?s>)|(?<=\[)(?=/?(?:INST|SYS|ANSWER|ROLE))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame, message: tuple[str, ...] = ("message",)) -> DataFrame:
    """conv_id, the columns that name a message, role and text of the final messages.

    All of it needs a message's events together, so they are shuffled once at most.
    """
    events = events.select("conv_id", *message, "seq", "kind", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", *message).orderBy("seq", "kind", "text")
    begun = events.withColumn("version", F.sum(F.col("kind").isin(*STARTS).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begun = begun.withColumn("role", F.last("role", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begun = begun.withColumn("last", F.max("version").over(Window.partitionBy("conv_id", *message))).filter("version = last")
    part = F.struct("seq", F.col("kind").isin(*STARTS).alias("starts"), "kind", "text", "role")
    parts = begun.groupBy("conv_id", *message).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    # the event that starts a version comes first, whatever the kinds of events at its seq
    start, rest = F.filter("parts", lambda p: p.starts), F.filter("parts", lambda p: ~p.starts)
    texts = F.transform(F.concat(start, rest), lambda p: p.text)
    role = F.try_element_at(F.filter(F.transform(F.concat(start, rest), lambda p: p.role), lambda r: r.isNotNull()), F.lit(1))
    return parts.select("conv_id", *message, F.coalesce(role, F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))


def tag(role: Column) -> Column:
    found = F.concat(F.lit("ROLE:"), F.regexp_replace(escape(role), r"\]", r"\\]"))
    for name, mark in TAGS.items():
        found = F.when(role == name, F.lit(mark)).otherwise(found)
    return found


def render(messages: DataFrame, message: tuple[str, ...] = ("message",)) -> DataFrame:
    """conv_id, formatted, mask: spans (start, length) in characters of what the loss covers, with the turn each is in and its place there.

    Turns are placed by running sums over the rows of a conversation, so its length costs no more than in proportion.
    """
    pieces = messages.select("conv_id", F.struct(*message).alias("message"), tag(F.col("role")).alias("tag"), (F.col("role") == "assistant").alias("loss"), escape(F.col("text")).alias("body"))
    head, tail = F.concat(F.lit("<s>["), "tag", F.lit("] ")), F.concat(F.lit(" [/"), "tag", F.lit("]</s>"))
    turns = pieces.select("conv_id", "message", "loss", F.concat(head, "body", tail).alias("turn"), F.length(head).alias("before"), F.length("body").alias("size"))
    order = Window.partitionBy("conv_id").orderBy("message")
    starts = F.coalesce(F.sum(F.length("turn")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select("conv_id", "loss", "turn", "before", "size", (F.row_number().over(order) - 1).alias("place"), starts.alias("at"))
    span = F.struct((F.col("at") + F.col("before")).cast("int").alias("start"), F.col("size").alias("length"), F.col("place").alias("turn"), F.col("before").alias("within"))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "turn"))).alias("turns"), F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("mask"))
    return gathered.select("conv_id", F.array_join(F.transform("turns", lambda t: t.turn), "").alias("formatted"), "mask")


def under_mask(formatted: str, mask: str) -> Column:
    """The texts under a loss mask, read from the formatted string and unescaped.

    The string is cut at the ends of its turns, so each span is looked up in its own turn and not counted from the start.
    """
    # both are bound once: an expression inside the inner function would be evaluated for each span
    both = F.array(F.struct(F.split(F.col(formatted), "</s>").alias("turns"), F.col(mask).alias("spans")))
    read = lambda b: F.transform(b["spans"], lambda s: unescape(F.substring(F.get(b["turns"], s["turn"]), s["within"] + 1, s["length"])))
    return F.get(F.transform(both, read), F.lit(0))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted string."""
    turns = F.filter(F.split(formatted, "</s>"), lambda t: t != "")
    marked = F.transform(turns, lambda t: F.struct(t.alias("turn"), F.regexp_extract(t, r"(?s)^<s>\[((?:[^\]\\]|\\.)*)\] ", 1).alias("tag")))

    def read_turn(t: Column) -> Column:
        size = F.length(t.tag)
        role = unescape(F.substring(t.tag, len("ROLE:") + 1, 2**31 - 1))
        for name, mark in TAGS.items():
            role = F.when(t.tag == mark, F.lit(name)).otherwise(role)
        # <s>[TAG] before and [/TAG] with a space after
        body = F.substring(t.turn, size + 7, F.length(t.turn) - 2 * size - 10)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(marked, read_turn)


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log that a chat service would have written of them.

    A message comes as a beginning and a streamed delta; every third one is a draft that an edit replaces, every
    third one an answer that is regenerated and streamed in two deltas.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.select("conv_id", "turn", tie.alias("tie"), "role", "text", F.pmod(F.xxhash64("turn", "text"), F.lit(3)).alias("way"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    # one sequence for the conversation: a message still streams when the next ones have begun
    at = F.coalesce(F.col("turn"), F.lit(0)).cast("decimal(30,0)") * 3
    event = lambda seq, kind, role, text: F.struct((at + 4 * seq).cast("decimal(38,0)").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    role, none = F.col("role"), F.lit(None).cast("string")
    streamed = F.array(event(0, "message", role, first), event(1, "delta", none, rest))
    edited = F.array(event(0, "message", role, rest), event(1, "delta", none, first), event(2, "edit", none, F.col("text")))
    again = F.array(event(0, "message", role, rest), event(1, "regenerate", none, F.lit("")), event(2, "delta", none, first), event(3, "delta", none, rest))
    log = rows.select("conv_id", "turn", "tie", F.explode(F.when(F.col("way") == 0, streamed).when(F.col("way") == 1, edited).otherwise(again)).alias("e"))
    return log.select("conv_id", "turn", "tie", "e.*")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each formatted conversation, read back from it."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    done = render(fold(as_events(rows.unionByName(extra)), MESSAGE), MESSAGE)
    back = done.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(under_mask("formatted", "mask"), "").alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: formatted_chars follows from the template: 14 characters and twice the tag per turn, a character for each escape.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)
), marked AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?(INST|SYS|ANSWER|ROLE))', '[\\\1', 'g') AS body,
    CASE role WHEN 'user' THEN 'INST' WHEN 'system' THEN 'SYS' WHEN 'assistant' THEN 'ANSWER' ELSE 'ROLE:' || role END AS tag
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + 2 * length(tag) + 14) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
