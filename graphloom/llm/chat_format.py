"""Chat formatting: turns to text segments with loss flags, and back.

A finite-state machine over roles checks the order of turns while a template
turns each turn into three segments: a header, the text and an end mark. Only
the text segment of a role that the template trains on carries the loss.

Inside texts every character that begins one of the template's marks is
escaped, so a text can hold any control string and still be read back.

Conversations are dealt out by id, sorted by turn inside a partition and
streamed, so memory does not depend on how long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


@dataclass(frozen=True)
class Template:
    """Fixed strings of a chat format.

    ``moves`` is the state machine: for each state, the roles that may come and
    the state after them. A role without a header of its own is written by
    ``other`` with its name, escaped.
    """

    headers: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### Role=", ": ")
    end: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})

    @property
    def special(self) -> str:
        return "".join(sorted({self.escape, self.other[0][0], self.other[1][0], self.end[0], *(h[0] for h in self.headers.values())}))

    def escaped(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.special)}])", lambda m: self.escape + m[1], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def header(self, role: str) -> str:
        return self.headers.get(role) or self.other[0] + self.escaped(role) + self.other[1]

    def reader(self) -> re.Pattern:
        """One whole turn of formatted text: a header, an escaped text, the end mark."""
        plain = f"(?:{re.escape(self.escape)}.|[^{re.escape(self.special)}])*"
        known = "|".join(f"(?P<r{i}>{re.escape(h)})" for i, h in enumerate(self.headers.values()))
        return re.compile(f"(?:{known}|{re.escape(self.other[0])}(?P<role>{plain}){re.escape(self.other[1])})(?P<text>{plain}){re.escape(self.end)}", re.S)


DEFAULT = Template()
SEGMENTS = "turn_index bigint, part int, segment string, loss boolean, state string"


def _ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def format_chats(turns: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id") -> DataFrame:
    """(id, ``SEGMENTS``): the segments of each conversation, three for each row of ``turns``.

    Turns go by ``turn`` (null first), then role, then text, so ties and
    repeated rows have one order. A null text is empty and a null role is the
    role of no name. ``state`` is the state after the turn, or ``invalid`` from
    the first turn that the state machine refuses. A null conversation id is an
    id like any other. An empty table gives no rows; other columns are ignored.
    """
    kind = turns.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, at = object(), "", 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text"))):
                if conv != last:
                    last, state, at = conv, "start", 0
                role = role or ""
                state = template.moves.get(state, {}).get(role, "invalid")
                texts = (template.header(role), template.escaped(text or ""), template.end)
                out += [(conv, at, part, segment, part == 1 and role in template.loss_roles, state) for part, segment in enumerate(texts)]
                at += 1
            yield _rows(out, schema)

    schema = [("id", to_arrow_type(turns.schema[id_col].dataType)), ("turn_index", pa.int64()), ("part", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_()), ("state", pa.string())]
    base = turns.select(F.col(id_col).alias("id"), "turn", "role", "text")
    return _ordered(base, "id", "turn", "role", "text").mapInArrow(run, f"id {kind}, {SEGMENTS}").withColumnRenamed("id", id_col)


def _rows(rows: list[tuple], schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


READ = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


def read_chats(segments: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id") -> DataFrame:
    """(id, ``READ``): digests of each conversation, read from its formatted text.

    Roles and texts are parsed from the segments' text alone; text is held only
    until its turn ends. ``turns_sha256`` is over role, newline, text and
    newline of each turn; ``loss_*`` are over the unescaped text under the
    loss. Text that is not in the template's format is an error. An empty table
    gives no rows. A null id is an id like any other: all its rows go to one
    task, which streams them.
    """
    kind = segments.schema[id_col].dataType.simpleString()
    schema = [("id", to_arrow_type(segments.schema[id_col].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]

    class Reading:
        def __init__(self, conv):
            self.conv, self.held, self.turns, self.chars, self.loss, self.valid = conv, [], 0, 0, 0, True
            self.said, self.learnt = hashlib.sha256(), hashlib.sha256()

        def row(self) -> tuple:
            if self.held:
                raise ValueError(f"conversation {self.conv} ends within a turn")
            return self.conv, self.turns, self.said.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars, self.valid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, roles, now = template.reader(), list(template.headers), None
        for batch in batches:
            out: list[tuple] = []
            for conv, segment, loss, state in zip(*(batch.column(c).to_pylist() for c in ("id", "segment", "loss", "state"))):
                if now is None or now.conv != conv:
                    out += [now.row()] if now else []
                    now = Reading(conv)
                now.held.append(segment)
                now.chars += len(segment)
                now.valid &= state != "invalid"
                if loss:
                    text = template.unescaped(segment)
                    now.loss += len(text)
                    now.learnt.update(text.encode())
                if segment.endswith(template.end) and (m := pattern.fullmatch("".join(now.held))):
                    known = next((r for i, r in enumerate(roles) if m[f"r{i}"] is not None), None)
                    role = template.unescaped(m["role"]) if known is None else known
                    now.said.update(f"{role}\n{template.unescaped(m['text'])}\n".encode())
                    now.turns, now.held = now.turns + 1, []
            yield _rows(out, schema)
        if now:
            yield _rows([now.row()], schema)

    base = segments.select(F.col(id_col).alias("id"), "turn_index", "part", "segment", "loss", "state")
    return _ordered(base, "id", "turn_index", "part").mapInArrow(run, f"id {kind}, {READ}").withColumnRenamed("id", id_col)
