"""Chat formatting that is proved by reading it back.

A conversation is written by this grammar, in which no text holds a control string:

    conversation := "<s>" turn+
    turn         := "[INST] " text " [/INST]"                       role user
                  | " " text " </s>"                                role assistant
                  | "[ROLE] " role " [TEXT] " text " [/ROLE]"       any other role

The first character of a turn tells the three kinds apart and every turn ends at the first control string that
closes one, so the parser never has a choice. Each turn is written as it stands and parsed again. Where the parser
does not give back the same role and text, the turn is written anew with one backslash more behind the first
character of everything that looks like a control string with any number of backslashes; reading takes one away.
A last parse of the whole conversation must give back all its turns, or the query fails. All of it is DataFrame
functions.

Null roles and texts count as empty. Turns go by `turn`, nulls first, and turns that share a number by what they
are written as; rows of a null conversation form one conversation. Repeated rows are repeated turns. A table without
rows gives no conversation. A conversation of any number of turns and texts of any length become one row, as a
training example is one text. Columns beyond the four named are not read, whatever they are called.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemart.llm.session import table

START = "<s>"
USER, ASSISTANT = "user", "assistant"
#: What a turn of the two known roles opens and closes with.
MARKS = {USER: ("[INST] ", " [/INST]"), ASSISTANT: (" ", " </s>")}
ROLE_OPEN, ROLE_TEXT, ROLE_CLOSE = "[ROLE] ", " [TEXT] ", " [/ROLE]"

CONTROL = r"[\[<](?:(?<=<)/?s>|(?<=\[)(?:/?INST\]|/?ROLE\]|TEXT\]))"
_TAILS = r"/?s>|/?INST\]|/?ROLE\]|TEXT\]"
ESCAPABLE = rf"([\[<])(\\*)({_TAILS})"
ESCAPED = rf"([\[<])\\(\\*)({_TAILS})"
# The first look back, at one character, spares the second at most places.
_TURN_END = r"(?<=[>\]])(?<=" + "|".join(re.escape(c) for c in (MARKS[USER][1], MARKS[ASSISTANT][1], ROLE_CLOSE)) + ")"
_TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """One turn as written, its role and text taken as they are."""
    written = F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_TEXT), text, F.lit(ROLE_CLOSE))
    for name, (head, tail) in MARKS.items():
        written = F.when(role == name, F.concat(F.lit(head), text, F.lit(tail))).otherwise(written)
    return written


def _between(piece: Column, head: str, tail: str) -> Column:
    return F.substr(piece, F.lit(len(head) + 1), F.length(piece) - len(head) - len(tail))


def _framed(piece: Column, head: str, tail: str) -> Column:
    return F.startswith(piece, F.lit(head)) & F.endswith(piece, F.lit(tail)) & (F.length(piece) >= len(head) + len(tail))


def _read(piece: Column) -> Column:
    """Role and text of one written turn, still escaped; null where its frame does not fit."""
    parts = F.split(_between(piece, ROLE_OPEN, ROLE_CLOSE), re.escape(ROLE_TEXT), 2)
    # `try_element_at` gives null, not an error, where there is no text mark.
    turn = F.when(
        _framed(piece, ROLE_OPEN, ROLE_CLOSE), F.struct(F.try_element_at(parts, F.lit(1)).alias("role"), F.try_element_at(parts, F.lit(2)).alias("text"))
    )
    for name, (head, tail) in MARKS.items():
        turn = F.when(_framed(piece, head, tail), F.struct(F.lit(name).alias("role"), _between(piece, head, tail).alias("text"))).otherwise(turn)
    return turn.cast(_TURN)


def _told(turn: Column) -> Column:
    """The turn unescaped; null if it lacks a text or holds a control string."""
    clean = ~F.rlike(turn["role"], F.lit(CONTROL)) & ~F.rlike(turn["text"], F.lit(CONTROL))
    return F.when(clean, F.struct(unescape(turn["role"]).alias("role"), unescape(turn["text"]).alias("text")))


def pieces(formatted: Column) -> Column:
    """The written turns of a conversation, cut behind each closing control string."""
    rest = F.when(F.startswith(formatted, F.lit(START)), F.substr(formatted, F.lit(len(START) + 1)))
    return F.filter(F.split(rest, _TURN_END), lambda p: p != "")


def parse(formatted: Column) -> Column:
    """The turns of a written conversation as (role, text); a turn that breaks the grammar is null.

    Two steps, as a lambda's variable is worked out once and an expression as often as it is named.
    """
    return F.transform(F.transform(pieces(formatted), _read), _told)


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(role, F.lit("\n"), text, F.lit("\n")), 256)


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: `conv`, `formatted`, and `spans` with an entry per turn.

    A span holds where its turn starts in `formatted` and, for assistants, where the text that counts for the loss
    starts and ends; all in code points, ends exclusive.
    """
    plain = rows.select(
        F.col(conv).alias("__conv"), F.col(turn).alias("__turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("__role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"),
    )
    source = F.array(F.struct(F.col("__role").alias("role"), F.col("__text").alias("text")))
    first = plain.withColumn("__plain", render(F.col("__role"), F.col("__text")))
    told = first.withColumn("__same", F.coalesce(parse(F.concat(F.lit(START), "__plain")) == source, F.lit(False)))
    again = F.when(F.col("__same"), F.col("__plain")).otherwise(
        # A known role holds no control string, so its escape is itself and the marks stay.
        render(escape(F.col("__role")), escape(F.col("__text")))
    )
    written = told.select(
        "__conv", "__turn", again.alias("__piece"), (F.col("__role") == ASSISTANT).alias("__loss"),
        _digest(F.col("__role"), F.col("__text")).alias("__source"),
    )
    before = Window.partitionBy("__conv").orderBy("__turn", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("__piece").cast("bigint")
    placed = written.select(
        "__conv", (F.coalesce(F.sum(size).over(before), F.lit(0)) + len(START)).alias("__start"), "__piece", "__loss", "__source",
    )
    head, tail = (len(x) for x in MARKS[ASSISTANT])
    start, end = F.col("__start"), F.col("__start") + F.length("__piece")
    span = F.struct(
        start.alias("start"), F.when(F.col("__loss"), start + head).alias("loss_start"), F.when(F.col("__loss"), end - tail).alias("loss_end")
    )
    whole = placed.groupBy("__conv").agg(
        F.array_sort(F.collect_list(F.struct(span.alias("span"), F.col("__piece").alias("piece"), F.col("__source").alias("source")))).alias("__turns")
    )
    joined = whole.select(
        "__conv", F.concat(F.lit(START), F.array_join("__turns.piece", "")).alias("formatted"),
        F.col("__turns.span").alias("spans"), F.col("__turns.source").alias("__source"),
    )
    back = F.transform(parse(F.col("formatted")), lambda t: _digest(t["role"], t["text"]))
    proved = F.when(F.coalesce(back == F.col("__source"), F.lit(False)), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.col("__conv").cast("string"))).cast("string")
    )
    return joined.select(F.col("__conv").alias(conv), proved.alias("formatted"), "spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, joined in order with nothing between."""

    def masked(piece: Column, span: Column) -> Column:
        at = (span["loss_start"] - span["start"] + 1).cast("int")
        return F.when(span["loss_start"].isNotNull(), unescape(F.substr(piece, at, (span["loss_end"] - span["loss_start"]).cast("int"))))

    return F.array_join(F.array_compact(F.zip_with(pieces(formatted), spans, masked)), "")


#: The added conversation quotes control strings in both of its turns.
ADDED_ID, ADDED_TEXT = -1, "</s>[INST] ok [/INST]"


def with_added(rows: DataFrame) -> DataFrame:
    """The conversations and one more that says control strings; its key keeps it apart from rows of the same id."""
    added = rows.sparkSession.range(2).select(
        F.struct(F.lit(ADDED_ID).cast(rows.schema["conv_id"].dataType).alias("id"), F.lit(True).alias("added")).alias("key"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, USER).otherwise(ASSISTANT).alias("role"), F.lit(ADDED_TEXT).alias("text"),
    )
    own = rows.select(F.struct(F.col("conv_id").alias("id"), F.lit(False).alias("added")).alias("key"), "turn", "role", "text")
    return own.unionByName(added)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of formatted conversations, all taken from `formatted` and its `spans`."""
    text = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    seen = formatted.withColumn("__turns", parse(F.col("formatted"))).select(
        conv, F.size("__turns").cast("bigint").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        loss_text(F.col("formatted"), F.col("spans")).alias("__loss"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return seen.select(
        conv, "n_turns", "turns_sha256", F.length("__loss").cast("bigint").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = format_conversations(with_added(table(spark, sf_dir, "conversations")), "key")
    return read_back(formatted, "key").select(F.col("key.id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL12 = r"""
WITH t AS (
  SELECT conv_id, false AS added, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, true, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, true, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([\[<])(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([\[<])(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g') AS x FROM t),
w AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || x || ' [/INST]' WHEN 'assistant' THEN ' ' || x || ' </s>'
                      ELSE '[ROLE] ' || r || ' [TEXT] ' || x || ' [/ROLE]' END AS piece FROM e),
g AS (
  SELECT conv_id, added, count(*) AS n_turns, sum(length(piece)) + 3 AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '') AS loss
  FROM w GROUP BY conv_id, added)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
