"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of turns to a string. The prefixes of a conversation are rendered
one after another; what a prefix adds to the one before is its last turn's span, and a second rendering
with a marker in place of that turn's text shows where in the span the text lies. If a prefix doesn't
begin with the one before, the template rewrites history: the conversation is flagged with the turn
and with the length of what stayed, and spans beyond that are given as unknown (-1).

A conversation is one record, formatted by one task, whatever its length; conversations are gathered by
their id in an ordinary aggregation. Turns are ordered by turn, then role, then text, and repeated rows stay.
Null texts and roles count as empty strings. Rows with a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches

Template = Callable[[list[dict]], str]
MARK = "\ue000"

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes, then puts one behind the first sign of each control string; no control string is left."""
    return _STARTS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def inst_template(turns: list[dict]) -> str:
    """Instructions in [INST] marks, answers up to </s>; other roles under a mark with their name."""
    out = []
    for t in turns:
        x = escape(t["text"])
        if t["role"] == "user":
            out.append(f"[INST] {x} [/INST]")
        elif t["role"] == "assistant":
            out.append(f" {x}</s>")
        elif t["role"] == "system":
            out.append(f"<<SYS>>\n{x}\n<</SYS>>\n\n")
        else:
            out.append(f"<|{escape(t['role'])}|>{x}<|end|>")
    return "".join(out)


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def spans(turns: list[dict], template: Template) -> dict:
    """formatted, turns (role, begin, end, text_begin, text_end), rewritten_at (0: never), stable_chars."""
    before, found, rewritten, stable, mark = "", [], 0, None, MARK
    while any(mark in t["text"] or mark in t["role"] for t in turns):
        mark += "\ue001"
    for k, turn in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            kept = _common(before, now)
            rewritten, stable = rewritten or k + 1, kept if stable is None else min(stable, kept)
            for s in found:
                if s["end"] > kept:
                    s.update(begin=-1, end=-1, text_begin=-1, text_end=-1)
            before = now[:kept]
        span = {"role": turn["role"], "begin": len(before), "end": len(now), "text_begin": -1, "text_end": -1}
        probe = template([*turns[:k], turn | {"text": mark}])
        if probe.startswith(before) and probe.count(mark) == 1:
            head, tail = probe[len(before) :].split(mark)
            if len(head) + len(tail) <= len(now) - len(before) and now.startswith(head, len(before)) and now.endswith(tail):
                span.update(text_begin=len(before) + len(head), text_end=len(now) - len(tail))
        found.append(span)
        before = now
    return {"formatted": before, "turns": found, "rewritten_at": rewritten, "stable_chars": len(before) if stable is None else stable}


SPANS = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("begin", "end", "text_begin", "text_end"))]))
SPANNED = "formatted string, turns array<struct<role:string,begin:long,end:long,text_begin:long,text_end:long>>, rewritten_at long, stable_chars long"


def render(conversations: DataFrame, template: Template = inst_template, key: str = "conv_id") -> DataFrame:
    """A row for each conversation: key, formatted text, spans of turns and of their texts, and what a rewriting template did."""
    small_batches(conversations.sparkSession)
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select(F.col(key).alias("key"), turn.alias("t")).groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("rows"))
    kind = whole.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans([{"role": r["role"], "text": r["text"]} for r in x], template) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[n] for x in found], t) for n, t in zip(("formatted", "turns", "rewritten_at", "stable_chars"), (pa.string(), SPANS, pa.int64(), pa.int64())))], names=["key", "formatted", "turns", "rewritten_at", "stable_chars"])

    return whole.mapInArrow(run, f"key {kind}, {SPANNED}").withColumnRenamed("key", key)


def read_back(formatted: DataFrame, key: str = "conv_id", undo: Callable[[str], str] = unescape, loss_role: str = "assistant") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the formatted text and its spans alone."""
    kind = formatted.schema[key].dataType.simpleString()

    def one(text: str, turns: list[dict]) -> dict:
        whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
        for t in turns:
            x = undo(text[t["text_begin"] : t["text_end"]]) if t["text_begin"] >= 0 else ""
            whole.update(f"{t['role']}\n{x}\n".encode())
            if t["role"] == loss_role:
                loss.update(x.encode())
                chars += len(x)
        return {"n_turns": len(turns), "turns_sha256": whole.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        for b in batches:
            found = [one(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[n] for x in found], t) for n, t in names.items()), b.column(3)], names=["key", *names, "rewritten_at"])

    cols = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at long"
    return formatted.select(F.col(key).alias("key"), "formatted", "turns", "rewritten_at").mapInArrow(run, f"key {kind}, {cols}").withColumnRenamed("key", key)
