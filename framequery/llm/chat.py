"""Chat formatting: a machine over roles checks the order of turns and emits segments of text with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATTED = "seq long, role string, state string, allowed boolean, start long, segments array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """What is written around turns, and which turn may follow which.

    opens: role -> the mark before its text. Other roles are written as `other`, the role's name, `named`.
    close ends every turn. loss: roles whose texts are trained on. moves: state -> role -> next state; a turn without a
    move isn't allowed, and the machine goes on in `resumes`. final: states in which a conversation may end.
    In texts and names the escape goes before itself and before every character that a mark starts with. So a mark's
    first character without an escape is a mark, whatever a text says, and texts are read back exactly.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role: "
    named: str = "</role>"
    close: str = "</turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    resumes: dict[str, str] = field(default_factory=lambda: {"system": "system", "user": "user", "assistant": "assistant"})
    final: frozenset[str] = frozenset({"assistant"})
    escape: str = "\\"

    def __post_init__(self) -> None:
        marks = self.marks
        if len(self.escape) != 1 or any(not m or self.escape in m for m in marks):
            raise ValueError("the escape is one character that no mark holds; no mark is empty")
        if any(a.startswith(b) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("no mark may start with another")
        states = {self.start, *self.moves, *self.resumes.values()}
        if not {t for m in self.moves.values() for t in m.values()} | self.final <= states:
            raise ValueError("a move leads to a state without moves of its own")

    @property
    def marks(self) -> list[str]:
        return [*self.opens.values(), self.other, self.named, self.close]

    @property
    def guarded(self) -> str:
        """A class of the characters that are escaped."""
        return "[" + "".join(f"\\{c}" for c in sorted({self.escape, *(m[0] for m in self.marks)})) + "]"

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn, and whether the turn was allowed. Unknown roles aren't and leave the state."""
        after = self.moves.get(state, {}).get(role)
        return (after, True) if after is not None else (self.resumes.get(role, state), False)


def format_turns(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn, a conversation's rows together and in order: conv_col, seq (from 0), role, state (after
    the turn), allowed, start (code points of the conversation's output before the turn) and segments, whose texts joined
    are the output. The segment of a text is under loss if its role is.

    Turns are ordered by turn_col (NULL first), then role and text, so repeated turns all stay, in one order. A NULL text
    is empty, a NULL role a role with an empty name, NULL conversations one conversation. Columns beside the four aren't
    read. Texts are escaped where they lie; one shuffle brings a conversation's turns together, and a task holds one
    batch of them and the machine's state, however long a conversation is.
    """
    guarded, escape = template.guarded, template.escape
    safe = lambda c: F.regexp_replace(c, f"({guarded})", rf"\{escape}$1")
    opens, loss, step = template.opens, template.loss, template.step
    conv_type = turns.schema[conv_col].dataType.simpleString()
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), safe(role).alias("name"), safe(text).alias("text"))
    segment = pa.struct([("text", pa.string()), ("loss", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, state, start = object(), 0, template.start, 0
        for batch in batches:
            out: list[tuple] = []
            for c, role, name, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if c != conv:
                    conv, seq, state, start = c, 0, template.start, 0
                state, allowed = step(state, role)
                before = opens.get(role) or f"{template.other}{name}{template.named}"
                parts = [(before, False), (text, role in loss), (template.close, False)]
                out.append((seq, role, state, allowed, start, [{"text": t, "loss": f} for t, f in parts]))
                seq, start = seq + 1, start + sum(len(t) for t, _ in parts)
            types = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(segment))
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv", "seq", "role", "state", "allowed", "start", "segments"])

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").select("conv", "role", "name", "text")
    return ordered.mapInArrow(run, f"conv {conv_type}, {FORMATTED}").withColumnRenamed("conv", conv_col)


def loss_spans(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The output as (conv_col, seq, start, output, spans): spans are [from, to) in code points of the conversation's
    output that are under loss. No shuffle."""
    ends = lambda s, k: F.col("start") + F.aggregate(F.slice(s, 1, k), F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    s = F.col("segments")
    spans = F.filter(F.transform(s, lambda x, k: F.when(x["loss"], F.struct(ends(s, k).alias("from"), ends(s, k + 1).alias("to")))), lambda x: x.isNotNull())
    return formatted.select(conv_col, "seq", "start", F.concat_ws("", F.transform(s, lambda x: x["text"])).alias("output"), spans.alias("spans"))


class Reader:
    """Reads turns back from output."""

    def __init__(self, template: Template):
        name = {mark: role for role, mark in template.opens.items()}
        quoted = "|".join(map(re.escape, sorted([*name, template.other], key=len, reverse=True)))
        body = rf"((?:[^{template.guarded[1:-1]}]++|{re.escape(template.escape)}.)*+)"
        self.turn = re.compile(rf"(?:({quoted})(?:(?<={re.escape(template.other)}){body}{re.escape(template.named)})?){body}{re.escape(template.close)}", re.S)
        self.names, self.escaped = name, re.compile(rf"{re.escape(template.escape)}(.)", re.S)

    def plain(self, text: str) -> str:
        return self.escaped.sub(r"\1", text)

    def turns(self, output: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn; raises where output isn't made of whole turns."""
        at = 0
        while at < len(output):
            m = self.turn.match(output, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            yield self.names.get(m[1]) if m[2] is None else self.plain(m[2]), self.plain(m[3])
            at = m.end()


def read_digests(spans: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """What loss_spans' rows hold, read back from output and spans alone: conv_col, n_turns, turns_sha256 (of role, \\n,
    text, \\n for each turn), loss_chars, loss_sha256 (of all text under loss, unescaped), formatted_chars.

    The rows must come as format_turns leaves them, a conversation's together and in order. A digest is a chain, so a
    conversation is read as one stream of rows; none is held.
    """
    conv_type = spans.schema[conv_col].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv, held = Reader(template), object(), None

        def row() -> tuple:
            return held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]

        def batch_of(keys: list, done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, done = [], []
            for c, start, output, parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        keys.append(conv)
                        done.append(row())
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in reader.turns(output):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode())
                for part in parts:
                    text = reader.plain(output[part["from"] - start : part["to"] - start])
                    held[2] += len(text)
                    held[3].update(text.encode())
                held[4] += len(output)
            yield batch_of(keys, done, kind)
        if held is not None:
            yield batch_of([conv], [row()], kind)

    rows = spans.select(F.col(conv_col).alias("conv"), "start", "output", "spans")
    schema = f"conv {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def order_report(formatted: DataFrame, conv_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """(conv_col, n_turns, valid, first_bad, complete): whether all turns were allowed, the first that wasn't, and
    whether the last state is final. Narrow rows, combined before they are shuffled."""
    last = F.max_by("state", "seq")
    bad = F.min(F.when(~F.col("allowed"), F.col("seq")))
    return formatted.select(conv_col, "seq", "state", "allowed").groupBy(conv_col).agg(
        F.count(F.lit(1)).alias("n_turns"), bad.isNull().alias("valid"), bad.alias("first_bad"), last.isin(list(template.final)).alias("complete")
    )
