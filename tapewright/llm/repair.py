"""Structure repair of conversations: turns are aligned to the alternating grammar ``(s?(ua)+)?`` at least cost.

Rows of a conversation are read as a stream sorted by turn, twice. The first reading finds each row's
fault and keeps one code a row, from which the repair is found; the second meets the repair first and digests the
repaired conversation as its texts pass by. Memory holds codes and text digests of one
conversation, never its texts.

The repair is Wagner and Fischer's alignment of the row codes with the grammar string of each feasible length:
keep, rerole, delete and insert. All these strings end alike, so the tables of all lengths are one table over (rows
left, target left), filled from the end, in which a length is where the alignment starts. An ``s`` can only be a
kept row before which all rows are deleted. Cells off the diagonal cost at least 2 for
each missing row or 3 for each row too many, so Ukkonen's band around it holds all cells that an alignment no
dearer than the incumbent can touch; the incumbent is a greedy repair first, then the result of narrower bands. Each length
of least cost is traced back into its audit, the least letter first, and the audits are compared.
Time and memory of one conversation are its rows times its cost.

Defined results: null roles and texts are one blank; rows without a turn come first, rows of equal turn are ordered by role
and text; rows without a conversation id form one conversation; conversations without rows (all of them not
``present``) give zeros, an empty audit and the digest of the empty string; no rows give no result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
_FAR = 1 << 40
_BLANK = " \t\n\v\f\r"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@dataclass
class Codes:
    """What an alignment needs of the rows: initials of roles, rows that must go, rows that cost more if they stay."""

    initials: list[str] = field(default_factory=list)
    gone: list[bool] = field(default_factory=list)
    cut: list[bool] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.initials)


def target(left: int) -> str:
    """Initial of the grammar string's character with ``left`` characters to its end, itself included; not for the ``s``."""
    return "a" if left % 2 else "u"


def greedy_cost(codes: Codes) -> int:
    """Cost of a plain repair: keep what fits, insert where the other side's turn is missing, rerole the rest."""
    cost, length = 0, 0
    system = False
    for initial, gone, cut in zip(codes.initials, codes.gone, codes.cut, strict=True):
        if gone:
            cost += DELETE
            continue
        cost += CUT * cut
        wanted = "a" if length % 2 else "u"
        if initial == "s" and not length and not system:
            system = True
        elif initial == wanted:
            length += 1
        elif initial in ("u", "a"):
            cost += INSERT
            length += 2
        else:
            cost += REROLE
            length += 1
    cost += INSERT * (length % 2 or 2 * (system and not length))
    return min(cost, DELETE * len(codes))


class _Band:
    """The table within a band: columns are target left minus rows left, from ``-low`` to ``high``."""

    def __init__(self, codes: Codes, low: int, high: int) -> None:
        n = len(codes)
        self.codes, self.low = codes, low
        self.step = np.zeros((n, low + high + 1), dtype=np.uint8)  # 0 delete, 1 insert, 2 keep or rerole
        off = np.arange(-low, high + 1)
        cost = np.where(off >= 0, INSERT * off, _FAR)
        self.starts: list[tuple[int, int, int, int]] = []  # cost, rows deleted before an s, first row aligned, target left
        for i in range(n - 1, -1, -1):
            left = off + (n - i)
            here = np.append(cost[1:], _FAR) + DELETE
            deleted = here
            if not codes.gone[i]:
                initial = codes.initials[i]
                wrong = REROLE if initial not in ("u", "a") else REROLE * (left % 2 == (initial == "u"))
                here = np.minimum(here, cost + wrong + CUT * codes.cut[i])
                if initial == "s":
                    self._system(i, cost, off + (n - i - 1))
            here[left < 0] = _FAR
            here = np.minimum(np.minimum.accumulate(here - INSERT * off) + INSERT * off, _FAR)
            inserted = np.append(_FAR, here[:-1]) + INSERT
            self.step[i] = np.where(deleted == here, 0, np.where(inserted == here, 1, 2))
            cost = here
        left = off + n
        self.starts += [(int(c), 0, 0, int(r)) for c, r in zip(cost, left, strict=True) if r >= 0 and r % 2 == 0 and c < _FAR]

    def _system(self, i: int, after: np.ndarray, left: np.ndarray) -> None:
        """Repairs whose s is row i: an even, non-empty rest follows."""
        fits = (left >= 2) & (left % 2 == 0) & (after < _FAR)
        first = DELETE * i + CUT * self.codes.cut[i]
        self.starts += [(first + int(c), i, i + 1, int(r)) for c, r in zip(after[fits], left[fits], strict=True)]

    def cost(self) -> int:
        return min((s[0] for s in self.starts), default=_FAR)

    def audit(self) -> str:
        """The least audit of all lengths of least cost."""
        best = self.cost()
        return min(self._trace(*start[1:]) for start in self.starts if start[0] == best)

    def _trace(self, before: int, i: int, left: int) -> str:
        n, out = len(self.codes), ["D" * before]
        if i:
            out.append("K")
        while i < n:
            step = self.step[i, left - (n - i) + self.low]
            if step == 0:
                out.append("D")
                i += 1
            elif step == 1:
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.codes.initials[i] == target(left) else "R")
                i += 1
                left -= 1
        out.append("I" * left)
        return "".join(out)


def align(codes: Codes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equal ones the one with the least audit."""
    if not len(codes):
        return 0, ""
    incumbent, width = greedy_cost(codes), 8
    while True:
        low, high = min(width, incumbent // DELETE), min(width, incumbent // INSERT)
        band = _Band(codes, low, high)
        incumbent = min(incumbent, band.cost())
        if low >= incumbent // DELETE and high >= incumbent // INSERT:
            return band.cost(), band.audit()
        width *= 2


class _Reading:
    """First reading: faults and the repair of one conversation."""

    def __init__(self, key) -> None:
        self.key, self.codes = key, Codes()
        self.seen: set[bytes] = set()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, present: bool) -> None:
        if not present:
            return
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        visible = text.rstrip(_BLANK)
        blank, duplicate = not visible, digest in self.seen
        cut = not blank and not duplicate and visible[-1] not in ".!?"
        self.seen.add(digest)
        self.counts["blank"] += blank
        self.counts["duplicate"] += duplicate and not blank
        self.counts["truncated"] += cut
        if len(self.codes):
            self.counts["illegal"] += self.codes.initials[-1] + role[:1] not in ("su", "ua", "au")
        self.codes.initials.append(role[:1])
        self.codes.gone.append(blank or duplicate)
        self.codes.cut.append(cut)

    def row(self) -> dict:
        self.counts["cost"], audit = align(self.codes)
        if self.first is not None:
            self.counts["gaps"] = self.last - self.first + 1 - self.turns
        return {"id": self.key, **self.counts, "audit": audit}


class _Writing:
    """Second reading: the repair comes first, then the rows."""

    def __init__(self, key) -> None:
        self.key, self.at, self.digest, self.written = key, 0, hashlib.sha256(), 0
        self.result: dict = {}
        self.left = 0

    def add(self, turn, role: str | None, text: str | None, present: bool, *result) -> None:
        if role is None:
            self.result = dict(zip((*_COUNTS, "audit"), result, strict=True))
            self.left = len(self.result["audit"]) - self.result["audit"].count("D")
        elif present:
            self._inserts()
            step = self.result["audit"][self.at]
            self.at += 1
            if step != "D":
                self._write(role if step == "K" else None, text)

    def _inserts(self) -> None:
        audit = self.result["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.at += 1
            self._write(None, "")

    def _write(self, role: str | None, text: str) -> None:
        role = role if role is not None else {"u": "user", "a": "assistant"}[target(self.left)]
        self.left -= 1
        self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written += 1

    def row(self) -> dict:
        self._inserts()
        return {"id": self.key, **self.result, "repaired_sha256": self.digest.hexdigest()}


def _folded(make: Callable, read: tuple[str, ...], out: list[tuple[str, pa.DataType]]) -> Callable:
    """A ``mapInArrow`` function: rows sorted by id go into one object an id, each of which gives a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, schema = None, None
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), *out])
            done = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in ("id", *read)), strict=True):
                if open_ is None or open_.key != key:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = make(key)
                open_.add(*values)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([open_.row()], schema=schema)

    return run


def repair_conversations(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows whose ``present_col`` is not true only name their conversation.
    """
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)).alias("present"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    found = [*((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())]
    read = ("turn", "role", "text", "present")
    order = ("id", F.col("role").isNotNull(), "turn", "role", "text")
    first = rows.repartition("id").sortWithinPartitions(*order).mapInArrow(_folded(_Reading, read, found), f"id {kind}, {counts}, audit string")
    both = rows.unionByName(first, allowMissingColumns=True).repartition("id").sortWithinPartitions(*order)
    second = both.mapInArrow(_folded(_Writing, (*read, *_COUNTS, "audit"), [*found, ("repaired_sha256", pa.string())]), f"id {kind}, {counts}, audit string, repaired_sha256 string")
    return second.withColumnRenamed("id", id_col)
