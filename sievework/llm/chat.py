"""Chat formatting (operator 5).

A declarative template says what stands around each role's text and whether it
counts for the loss. A finite-state machine over the roles validates the order
of turns and emits segments of text, each with a loss flag. Control strings
inside texts are escaped, so the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ship

#: What the template says: marks, the roles whose texts count for the loss, and the order of turns.
TEMPLATE = {
    "head": "### ",
    "mark": ": ",
    "end": " </turn>\n",
    "controls": ["###", "</turn>"],
    "loss": ["assistant"],
    "start": "begin",
    "moves": {
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered", "tool": "asked"},
        "answered": {"user": "asked", "tool": "asked"},
    },
    "finals": ["answered"],
}


def escape(text: str, controls: list[str]) -> str:
    """A backslash before each backslash and each control string."""
    return re.sub("|".join(map(re.escape, ["\\", *controls])), lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Machine:
    """Follows the roles of one conversation; after a wrong turn it stays invalid."""

    def __init__(self, template: dict):
        self.t, self.state, self.valid = template, template["start"], True

    def step(self, role: str) -> bool:
        after = self.t["moves"].get(self.state, {}).get(role)
        self.valid &= after is not None
        self.state = after or self.state
        return self.valid

    def ended_well(self) -> bool:
        return self.valid and self.state in self.t["finals"]


def turn_segments(role: str, text: str, template: dict) -> list[tuple[str, bool]]:
    """The formatted turn as (text, counts for the loss) segments."""
    t = template
    return [
        (t["head"] + escape(role, [*t["controls"], ":", "\n"]) + t["mark"], False),
        (escape(text, t["controls"]), role in t["loss"]),
        (t["end"], False),
    ]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, seq, text, loss, in_order) segments of each conversation, in order within partitions.

    turns has conv_id, turn, role and text; further columns are not used. Rows
    of a conversation are taken by turn (nulls first), ties by role and text.
    A null text or role is an empty one, and null conv_ids are one
    conversation. A conversation with a wrong order of turns is formatted all
    the same, and in_order is false from the first wrong turn on. Memory holds
    one batch of rows, however long a conversation is.
    """
    ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        now, machine, seq = object(), None, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, machine, seq = conv, Machine(template), 0
                ok = machine.step(role)
                for part, loss in turn_segments(role, text, template):
                    out.append((conv, seq, part, loss, ok))
                    seq += 1
            yield _batch(out, ["conv_id", "seq", "text", "loss", "in_order"], [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.bool_(), pa.bool_()])

    return rows.mapInArrow(run, f"conv_id {kind}, seq long, text string, loss boolean, in_order boolean")


class Reader:
    """Reads one formatted conversation back, segment by segment."""

    def __init__(self, template: dict):
        t = self.t = template
        self._end = re.compile(rf"(?:[^\\]|\\.)*?{re.escape(t['end'])}", re.S)
        self._mark = re.compile(rf"{re.escape(t['head'])}((?:[^\\:\n]|\\.)*){re.escape(t['mark'])}", re.S)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.buffer: list[str] = []
        self.in_order = True
        self.machine = Machine(template)

    def feed(self, text: str, loss: bool, in_order: bool) -> None:
        self.chars += len(text)
        self.in_order &= in_order
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.buffer.append(text)
        if text.endswith(self.t["end"]):
            self._read()

    def _read(self) -> None:
        text, at = "".join(self.buffer), 0
        while m := self._end.match(text, at):
            head = self._mark.match(text, at)
            if not head:
                raise ValueError(f"no mark of a turn at {text[at:at + 40]!r}")
            role, body = unescape(head[1]), unescape(text[head.end() : m.end() - len(self.t["end"])])
            self.machine.step(role)
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
            at = m.end()
        self.buffer = [text[at:]] if at < len(text) else []

    def row(self) -> tuple:
        if self.buffer:
            raise ValueError("the last turn has no end")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.in_order and self.machine.ended_well()


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row for each conversation, parsed from the segments of format_chats; segments keep their order."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    id_type = to_arrow_type(segments.schema["conv_id"].dataType)
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        now, reader = object(), None
        for batch in batches:
            out = []
            for conv, text, loss, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "in_order")), strict=True):
                if conv != now:
                    if reader:
                        out.append((now, *reader.row()))
                    now, reader = conv, Reader(template)
                reader.feed(text, loss, ok)
            yield _batch(out, names, types)
        if reader:
            yield _batch([(now, *reader.row())], names, types)

    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
