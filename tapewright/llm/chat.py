"""Chat formatting: a finite-state machine over roles, and a declared template that marks turns and loss.

Rows of a conversation are brought together by a sort within partitions and read as a stream, so memory
holds one turn, however long a conversation is. The machine checks the order of turns; conversations that
break it are formatted all the same and say so. Control strings inside a text are escaped: the escape
character and the first character of every control string get the escape character before them, so no
text can end its turn or start another one, and unescaping gives every text back.

Defined results: a null text is empty; a role without a name is written after a question mark (null as
empty) and breaks the order; rows without a turn number come first; rows of equal turn are ordered by role and text;
rows without a conversation id form one conversation of id null; no rows give no result; only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles may follow which, and whose text is learned."""

    opening: str = "### {role}: "
    closing: str = " </turn>\n"
    escape: str = "\\"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"user", "assistant"})

    def escaped(self, text: str, also: str = "") -> str:
        # The closing string begins with a blank; its first other character is guarded instead.
        inside = {self.escape, self.opening[0], self.closing.lstrip()[0], *also}
        return text.translate({ord(c): self.escape + c for c in inside})

    def shown(self, role: str) -> str:
        """A role as it is written: by its name, or, without one, after a question mark."""
        return self.names.get(role, f"?{role}")

    def meant(self, shown: str) -> str:
        return shown[1:] if shown.startswith("?") else {v: k for k, v in self.names.items()}[shown]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(string, learned) of one turn, in order."""
        after = self.opening.split("{role}")[1]
        head = self.opening.format(role=self.escaped(self.shown(role), after[0]))
        return [(head, False), (self.escaped(text), role in self.learned), (self.closing, False)]


DEFAULT = Template()


def read_turn(formatted: str, at: int, template: Template = DEFAULT) -> tuple[str, str, int]:
    """(role, text, end) of the turn that starts at ``at`` of a formatted string; the way back from ``segments``."""
    before, after = template.opening.split("{role}")
    if not formatted.startswith(before, at):
        raise ValueError(f"no turn at {at}")
    role, at = _read(formatted, at + len(before), after, template.escape)
    text, at = _read(formatted, at, template.closing, template.escape)
    return template.meant(role), text, at


def _read(formatted: str, at: int, stop: str, escape: str) -> tuple[str, int]:
    """The unescaped string up to ``stop``, and where that ends."""
    parts = []
    while True:
        end, mark = formatted.find(stop, at), formatted.find(escape, at)
        if mark >= 0 and (end < 0 or mark < end):
            parts += [formatted[at:mark], formatted[mark + 1 : mark + 2]]
            at = mark + 2
        elif end < 0:
            raise ValueError("turn without an end")
        else:
            parts.append(formatted[at:end])
            return "".join(parts), end + len(stop)


def format_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = DEFAULT) -> DataFrame:
    """One row per turn: id, position (from 0), role, and segments (text, loss) whose texts joined give the formatted string."""
    rows = _ordered(conversations, id_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, position, started = None, 0, False
        for batch in batches:
            ids, roles, texts = (batch.column(k).to_pylist() for k in ("id", "role", "text"))
            positions, segments = [], []
            for i, role, text in zip(ids, roles, texts, strict=True):
                position = position + 1 if started and i == key else 0
                key, started = i, True
                positions.append(position)
                segments.append([{"text": t, "loss": x} for t, x in template.segments(role, text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(positions, pa.int64()), batch.column("role"), pa.array(segments, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))],
                ["id", "position", "role", "segments"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, position bigint, role string, segments array<struct<text:string,loss:boolean>>").withColumnRenamed("id", id_col)


def _ordered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")


class _Conversation:
    """Running digests over the turns of one conversation, each read back from its formatted string."""

    def __init__(self, key, template: Template) -> None:
        self.key, self.template, self.state = key, template, "start"
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.problem: str | None = None

    def add(self, role: str, text: str) -> None:
        if role not in self.template.follows.get(self.state, ()) and self.problem is None:
            self.problem = f"{role or 'no role'} after {self.state} at {self.n_turns}"
        self.state = role
        segments = self.template.segments(role, text)
        formatted = "".join(t for t, _ in segments)
        role_back, text_back, end = read_turn(formatted, 0, self.template)
        if end != len(formatted):
            raise ValueError("a turn ends before its text does")
        self.n_turns += 1
        self.formatted_chars += len(formatted)
        self.turns.update(f"{role_back}\n{text_back}\n".encode())
        for part, learned in segments:
            if learned:
                plain = _read(part + self.template.closing, 0, self.template.closing, self.template.escape)[0]
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())

    def row(self) -> dict:
        problem = self.problem or (None if self.state in self.template.final else f"ends with {self.state}")
        return {
            "id": self.key, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars, "problem": problem,
        }


def conversation_digests(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, from its formatted turns read back: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, problem (null if the order of turns is valid)."""
    rows = _ordered(conversations, id_col, turn_col, role_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Conversation | None = None
        out_schema = None
        for batch in batches:
            out_schema = pa.schema([("id", batch.schema.field("id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("problem", pa.string())])
            done = []
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in ("id", "role", "text")), strict=True):
                if open_ is None or open_.key != key:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Conversation(key, template)
                open_.add(role, text)
            yield pa.RecordBatch.from_pylist(done, schema=out_schema)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([open_.row()], schema=out_schema)

    schema = f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, problem string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
