"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. It is asked for each prefix of a conversation, and
successive outputs are compared: what the next one adds is the turn's span. If an output does not begin with the one
before, the template rewrites history; the conversation is then marked, and spans are what follows the common prefix.
Where a turn's text lies in its span is found the same way, by rendering the turn with a mark in place of its text.
The loss mask is the texts of the assistant's turns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

# Fixed values of the format: a turn is OPEN role CLOSE text END, and CONTROL strings in a text get a backslash before them.
OPEN, CLOSE, END = "<turn ", ">\n", " </turn>\n"
CONTROL = ("<turn", "</turn", "###")
MARK = "\ue000\ue001\ue000"
LOSS = "assistant"


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for x in CONTROL:
        text = text.replace(x, "\\" + x)
    return text


def escaped_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(">", "\\>")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


class Marked:
    """The production template. It keeps the turns it has rendered, so that the next prefix costs a join."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], str] = {}

    def __call__(self, turns: Turns) -> str:
        known = self.known
        if len(known) > 4096:
            known.clear()
        return "".join(known.get(t) or known.setdefault(t, OPEN + escaped_role(t[0]) + CLOSE + escaped(t[1]) + END) for t in turns)


def parsed(output: str) -> Turns:
    """The turns of what Marked made."""
    turns, at = [], 0
    for m in re.finditer(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.|<(?!turn|/turn))*?) </turn>\n", output, flags=re.S):
        if m.start() != at:
            break
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(output):
        raise ValueError(f"no turn at {at}")
    return turns


def render(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(output, each turn's span, where its text is, whether the template rewrites history). Spans are in code points."""
    out, spans, texts, rewrites = template([]), [], [], False
    for k, (role, text) in enumerate(turns):
        new = template(turns[: k + 1])
        at = len(out)
        if not new.startswith(out):
            rewrites, at = True, len(os.path.commonprefix((out, new)))
        spans.append((at, len(new)))
        probe = template([*turns[:k], (role, MARK)])
        begin = probe.find(MARK, at)
        after = len(probe) - begin - len(MARK)
        texts.append((begin, len(new) - after) if begin >= 0 and new.startswith(probe[:begin]) else (at, at))
        out = new
    return out, spans, texts, rewrites


def format_conversations(rows: DataFrame, template: Callable[[], Template] = Marked, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, formatted, spans, loss, rewrites): a row for each conversation.

    spans: of turns, (start, end, role); loss: where texts of the assistant are; both in code points of formatted, end
    exclusive. Turns are ordered by turn, role and text, nulls first; rows repeated in full are turns of their own. A
    null text or role counts as empty; rows of a null key are one conversation. A conversation is read as a stream and
    held alone, so memory follows the longest one. An empty table gives an empty result; other columns are not read.
    """
    kind = dict(rows.dtypes)[key]
    given = rows.select(F.col(key).alias("k"), F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"))
    given = given.repartition("k").sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("n").asc_nulls_first(), F.col("r").asc_nulls_first(), F.col("t").asc_nulls_first()).select("k", "r", "t")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("role", pa.string())])
    loss = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, done, size = template(), [], 0
        at, turns = None, []

        def finish() -> int:
            out, spans, texts, rewrites = render(turns, made)
            named = [{"start": a, "end": b, "role": r} for (a, b), (r, _) in zip(spans, turns, strict=True)]
            masked = [{"start": a, "end": b} for (a, b), (r, _) in zip(texts, turns, strict=True) if r == LOSS]
            done.append((at[0], out, named, masked, rewrites))
            return len(out)

        def rows_() -> pa.RecordBatch:
            k, out, named, masked, rewrites = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, key_kind), pa.array(out, pa.string()), pa.array(named, pa.list_(span)), pa.array(masked, pa.list_(loss)), pa.array(rewrites)], names=[key, "formatted", "spans", "loss", "rewrites"])

        for batch in batches:
            key_kind = batch.schema.field(0).type
            for k, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at[0] != k:
                    size += finish()
                    turns = []
                    if size > 4 << 20:
                        yield rows_()
                        size = 0
                at = (k,)
                turns.append((r or "", t or ""))
        if at is not None:
            finish()
            yield rows_()

    return given.mapInArrow(run, f"`{key}` {kind}, formatted string, spans array<struct<start:long,end:long,role:string>>, loss array<struct<start:long,end:long>>, rewrites boolean")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from the output of format_conversations with Marked."""
    kind = dict(formatted.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns_, chars, loss_, size = [], [], [], [], []
            for out, masked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parsed(out)
                text = "".join(unescaped(out[x["start"] : x["end"]]) for x in masked)
                n.append(len(turns))
                turns_.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                chars.append(len(text))
                loss_.append(hashlib.sha256(text.encode()).hexdigest())
                size.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(turns_, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_, pa.string()), pa.array(size, pa.int64())], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(key, "formatted", "loss").mapInArrow(run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
