"""Chat formatting by event-sourced reconstruction (operator 8).

A conversation is a log of events in the order of ``seq``. Folding the log gives the final messages:

* ``message`` (message_id, role, text): a message, whole; without a message_id it is a message of its own
* ``delta`` (message_id, role, text): text streamed to the end of a message, which it opens if it is new
* ``edit`` (message_id, text): the message's text is replaced
* ``regenerate`` (message_id): the message starts anew with no text, and the messages after it are undone
* ``delete`` (message_id): the message is removed

The log is partitioned by conversation and sorted by sequence; a task folds it event by event as the rows stream by, so it holds
one conversation's messages at a time. The final messages are rendered in a template:

    ### role: text </turn>\\n

with the characters \\\\, # and < of role and text (and : of a role) behind a backslash, so no text can hold a mark, and reading is exact. The loss mask
is the spans, in code points, of the assistant texts (and nothing between).

Defined results: a null text counts as empty and a null role as the empty role; events of an unknown kind or of a message that is not
there (edit, regenerate, delete) change nothing; events of equal ``seq`` are folded in the order of message_id, kind, role and text, so
equal turns come in the order of role and text however the rows lie; repeated rows are repeated events; a null conversation is a conversation of its own; an empty table gives an empty result; further columns
of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import python_tasks, table

ESCAPED = re.compile(r"[\\#<]")
COLON, BACKSLASH = re.compile(":"), "\\\\"
TURN = re.compile(r"### ((?:[^\\#<:]|\\[\\#<:])*): ((?:[^\\#<]|\\[\\#<])*) </turn>\n", re.DOTALL)
#: The fixture that tests the escapes.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def fold(messages: dict[object, list[str]], kind: str, message_id: str | None, role: str, text: str) -> None:
    """One event; ``messages``: [role, parts of the text ...] by message_id (or something unique), in order."""
    if kind == "message":
        messages.pop(message_id, None)
        messages[object() if message_id is None else message_id] = [role, text]
    elif kind == "delta":
        messages.setdefault(message_id, [role]).append(text)
    elif message_id in messages:
        if kind == "edit":
            messages[message_id][1:] = [text]
        elif kind == "delete":
            del messages[message_id]
        elif kind == "regenerate":
            order = list(messages)
            for later in order[order.index(message_id) + 1 :]:
                del messages[later]
            messages[message_id][1:] = []


def render(messages: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[int]]:
    """The formatted conversation, and the loss mask: start, end, start, end, ..."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head = f"### {COLON.sub(BACKSLASH + ':', escape(role))}: "
        body = escape(text)
        if role == loss_role:
            mask += [at + len(head), at + len(head) + len(body)]
        turn = f"{head}{body} </turn>\n"
        out.append(turn)
        at += len(turn)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of ``render``."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


EVENT = "conv_id long, seq long, kind string, message_id string, role string, text string"


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans array<int>) of an event log with the columns of EVENT."""
    python_tasks(events.sparkSession)
    rows = events.select("conv_id", "seq", "kind", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(done: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
            texts = [render(m) for _, m in done]
            cols = [pa.array([c for c, _ in done], pa.int64()), pa.array([len(m) for _, m in done], pa.int64()), pa.array([t for t, _ in texts], pa.string()), pa.array([s for _, s in texts], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "formatted", "loss_spans"])

        now: dict[object, list[str]] = {}
        current: tuple[int | None] | None = None
        for batch in batches:
            done = []
            for conv, _, kind, message_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is not None and current[0] != conv:
                    done.append((current[0], [(m[0], "".join(m[1:])) for m in now.values()]))
                    now = {}
                current = (conv,)
                fold(now, kind, message_id, role, text)
            if done:
                yield made(done)
        if current is not None:
            yield made([(current[0], [(m[0], "".join(m[1:])) for m in now.values()])])

    return dealt.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<long>")


def digests(chats: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(spans[::2], spans[1::2], strict=True))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    return chats.mapInArrow(run, schema)


def as_events(conversations: DataFrame) -> DataFrame:
    """A log of whole messages, one for each row of (conv_id, turn, role, text)."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message_id"), "role", "text")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(formatted(as_events(rows)))
