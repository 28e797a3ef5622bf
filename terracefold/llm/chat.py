"""Chat formatting from event logs: fold a conversation's events into final messages, render them, read them back.

A log row is an event (conv_id, seq, kind, msg_id, role, text). Rows are partitioned by conversation and sorted by
sequence, and one pass folds them; a partition holds one conversation at a time. Kinds:
  message     a whole message with this role and text
  delta       text appended to the message (which the first delta begins)
  edit        text replaces the message's text; all later messages go
  regenerate  the message and all later ones go; deltas or messages that follow begin it anew
Other kinds are ignored. Messages come out in the order in which they (last) began.

The template marks each turn as OPEN role NEWLINE text CLOSE NEWLINE. Inside roles and texts the escape character is
doubled and control strings (the template's own and those of other well-known templates) get one after their first
character, so no control string occurs in a text and reading back gives the same text.

Defined results: a null text, role or kind is empty (a null kind is a message). A null conv_id is one conversation.
Repeated rows are repeated turns; ties in seq are ordered by role and text. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"
#: Fixed list: control strings of common templates.
CONTROLS = [OPEN, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_HIDE = re.compile("|".join([re.escape(ESCAPE), *map(re.escape, CONTROLS)]))
_SHOW = re.compile(re.escape(ESCAPE) + "(.)", re.S)


def escape(text: str) -> str:
    return _HIDE.sub(lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1", text)


def fold(events):
    """Final [role, text] messages of one conversation's (kind, msg_id, role, text) events."""
    order: list[str] = []
    found: dict[str, list] = {}  # [role, parts, place in the order]

    def begin(msg: str, role, parts: list[str]) -> None:
        found[msg] = [role or "", parts, len(order)]
        order.append(msg)

    def cut(msg: str, itself: bool) -> None:
        if msg in found:
            at = found[msg][2] + (not itself)
            for k in order[at:]:
                del found[k]
            del order[at:]

    for n, (kind, msg, role, text) in enumerate(events):
        text = text or ""
        msg = f"#{n}" if msg is None else msg
        if kind in (None, "", "message"):
            cut(msg, True)
            begin(msg, role, [text])
        elif kind == "delta":
            if msg not in found:
                begin(msg, role, [])
            found[msg][1].append(text)
        elif kind == "edit":
            cut(msg, False)
            if msg in found:
                found[msg][1] = [text]
        elif kind == "regenerate":
            cut(msg, True)
    return [(found[k][0], "".join(found[k][1])) for k in order]


def render(turns) -> str:
    return "".join(f"{OPEN}{_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def _role(role: str) -> str:
    return escape(role).replace("\n", ESCAPE + "l")


def _read_role(role: str) -> str:
    return _SHOW.sub(lambda m: "\n" if m[1] == "l" else m[1], role)


def read(formatted: str):
    """(role, text, start of the text, end of the text) of each turn of a rendered conversation."""
    at, out = 0, []
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a turn must open")
        end = formatted.index(CLOSE, at)
        body = formatted[at + len(OPEN) : end]
        role, _, text = body.partition("\n")
        start = at + len(OPEN) + len(role) + 1
        out.append((_read_role(role), unescape(text), start, end))
        at = end + len(CLOSE) + 1
    return out


_SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:long,stop:long>>"


def _conversations(batches):
    """(conv_id, formatted, loss spans) from sorted event rows."""
    current, events, ready = None, [], []

    def close():
        text = render(fold(events))
        ready.append((current[0], text, [{"start": s, "stop": e} for role, _, s, e in read(text) if role == "assistant"]))

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.string()), pa.array([r[2] for r in ready], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            ["conv_id", "formatted", "loss_spans"],
        )
        ready.clear()
        return out

    for batch in batches:
        for conv, kind, msg, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or current[0] != conv:
                if current is not None:
                    close()
                current, events = (conv,), []
            events.append((kind, msg, role, text))
        if len(ready) > 500:
            yield flush()
    if current is not None:
        close()
    if ready:
        yield flush()


def format_log(log: DataFrame) -> DataFrame:
    """One row per conversation of an event log: conv_id, formatted, loss_spans (code points of the assistants' escaped texts)."""
    rows = log.select(
        F.col("conv_id").cast("long"), "seq", F.col("kind"), F.col("msg_id").cast("string"), F.col("role"), F.col("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return dealt.select("conv_id", "kind", "msg_id", "role", "text").mapInArrow(_conversations, _SCHEMA)


def _digests(batches):
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            turns = read(text)
            loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def turns_as_log(conversations: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as the events of a chat server: an assistant's answer streams in two parts
    after a first try that is regenerated, a user's message is edited after a draft, others come whole. Rows of one turn
    follow each other by role and text."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(by).cast("long"))
    half = F.ceil(F.length("text") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    answer = F.array(event("delta", left), event("regenerate", F.lit("")), event("delta", left), event("delta", right))
    asked = F.array(event("message", left), event("edit", F.col("text")))
    events = F.when(F.col("role") == "assistant", answer).when(F.col("role") == "user", asked).otherwise(F.array(event("message", F.col("text"))))
    each = rows.select("conv_id", "n", "role", F.posexplode(events).alias("k", "e"))
    return each.select("conv_id", (F.col("n") * 4 + F.col("k")).alias("seq"), "e.kind", F.col("n").cast("string").alias("msg_id"), "role", "e.text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    return digests(format_log(turns_as_log(rows.unionByName(extra))))
