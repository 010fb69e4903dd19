"""Operator 10: conversations in reply order, with quotes linked to their originals and left out.

Each message is cut into its own lines and quoted passages (runs of lines at one quote level).
Passages are normalised and hashed; a passage that is no whole message, paragraph or line of an
earlier message falls back to its lines. Hashes join to the earliest message of the conversation
that says them, so a passage said by many never multiplies rows. A message replies to the message
with the lowest quote level, then the most quoted characters, then the latest turn.

Order: replies stand after the message at the root of their chain, by turn. Roots are found by
pointer doubling over quoting messages alone, so a conversation of any size is never gathered.

Defined cases: a null or empty text has no quotes and an empty text; a message with a null
conversation or turn is never linked; rows that share a conversation and turn are one message
to link to; a quote of a later or unknown message stays unlinked; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidewire.llm.common import small_batches, written

_LEVEL = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_SAYS = re.compile(r"^\s*(?:On\b.{0,300}\bwrote|Am\b.{0,300}\bschrieb.{0,100}|Le\b.{0,300}\ba écrit|El\b.{0,300}\bescribió)\s*:\s*$")


def normalised(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def passage_key(text: str) -> int | None:
    """Signed 64-bit hash of the normalised passage; none if nothing is left."""
    body = normalised(text)
    value = xxhash.xxh64_intdigest(body.encode("utf-8", "replace")) if body else None
    return value - (1 << 64) if value is not None and value >= 1 << 63 else value


def parsed(text: str | None) -> tuple[str, list[int], list[dict]]:
    """Own text, the keys it can be quoted by, and its quoted passages with level and keys."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        found = _LEVEL.match(line)
        if found:
            level, body = found[1].count(">"), line[found.end():]
            if own and _SAYS.match(own[-1]):
                own.pop()
            if passages and passages[-1][0] == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        else:
            own.append(line)
            if passages and passages[-1][1]:
                passages.append((0, []))  # own words end a passage
    body = "\n".join(own).strip("\n")
    parts = [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]
    keys = sorted({k for k in map(passage_key, parts) if k is not None})
    quotes = []
    for level, lines in passages:
        if level:
            whole = passage_key("\n".join(lines))
            quotes.append({"level": level, "chars": len(normalised("\n".join(lines))), "whole": whole,
                           "lines": [{"key": k, "chars": len(normalised(x))} for x in lines
                                     if (k := passage_key(x)) is not None]} if whole is not None else
                          {"level": level, "chars": 0, "whole": None, "lines": []})
    return body, keys, quotes


_LINES = pa.list_(pa.struct([("key", pa.int64()), ("chars", pa.int32())]))
_QUOTES = pa.list_(pa.struct([("level", pa.int32()), ("chars", pa.int32()), ("whole", pa.int64()), ("lines", _LINES)]))
PARSED = ("text string, own array<bigint>, "
          "quotes array<struct<level int, chars int, whole bigint, lines array<struct<key bigint, chars int>>>>")


def read_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own text, own keys, quotes) of each message."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            got = [parsed(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int64())),
                       pa.array([g[2] for g in got], _QUOTES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *columns],
                                             ["conv_id", "turn", "role", "text", "own", "quotes"])

    source = messages.select("conv_id", "turn", "role", "text")
    return source.mapInArrow(read, T.StructType([*source.schema.fields[:3], *T.StructType.fromDDL(PARSED).fields]))


def linked(read: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of the messages whose quotes are found earlier."""
    known = read.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    originals = known.select("conv_id", "turn", F.explode("own").alias("key")).groupBy("conv_id", "key").agg(
        F.min("turn").alias("origin"))
    quotes = known.filter(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", "q.level", F.coalesce("q.whole", F.lit(0)).alias("passage"),
        F.explode(F.concat(F.array(F.struct(F.col("q.whole").alias("key"), F.col("q.chars").alias("chars"),
                                            F.lit(True).alias("whole"))),
                           F.transform("q.lines", lambda x: F.struct(
                               x["key"].alias("key"), x["chars"].alias("chars"), F.lit(False).alias("whole"))))).alias("k"))
    quotes = quotes.select("conv_id", "turn", "level", "passage", "k.*").filter("key IS NOT NULL").distinct()
    found = quotes.join(originals, ["conv_id", "key"]).filter("origin < turn")
    # Lines count only where the passage as a whole is not found.
    votes = found.groupBy("conv_id", "turn", "level", "passage", "origin").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("chars"))
    best = votes.groupBy("conv_id", "turn", "level", "passage").agg(
        F.max(F.struct("whole", "chars", "origin")).alias("b"))
    return best.groupBy("conv_id", "turn").agg(
        F.max_by("b.origin", F.struct(-F.col("level"), F.col("b.chars"), F.col("b.origin"))).alias("reply_to"),
        F.count("*").cast("int").alias("n_linked"))


def rooted(links: DataFrame) -> DataFrame:
    """links with ``thread``: the turn at the root of each chain, by pointer doubling."""
    now = written(links.withColumn("thread", F.col("reply_to")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        step = written(now.join(up, ["conv_id", "thread"], "left").select(
            *links.columns, F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved")))
        moved = step.filter("moved").limit(1).count()
        now = step.drop("moved")
        if not moved:
            return now


def reply_ordered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, n_quotes, n_linked), one row a message.

    ``text`` is without quotes. Rows sorted by conv_id, thread, turn are the conversation in reply
    order: every reply stands after what it replies to, and right with its thread.
    """
    read = written(read_messages(messages))
    links = rooted(linked(read))
    return read.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def chat_lines(ordered: DataFrame, form: str = "<|%s|>\n%s\n") -> DataFrame:
    """Add ``line``: the message in a chat form of role and text."""
    return ordered.withColumn("line", F.format_string(
        form, F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))))
