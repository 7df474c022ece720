"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says how turns are marked, which roles are trained on, and which role may follow
which.  Turns of a conversation, in order, run through the machine; each becomes three segments: opening mark
with the role, text, closing mark.  Only the text of a trained role is under the loss.
The machine's verdict on every turn goes along: a turn out of order is formatted all the same
and marked, so no conversation is lost.

Control strings inside a text (or a role) cannot be taken for marks: every ``<``, any
backslashes, ``|`` in it gets one backslash more, and reading back takes one away.

Turns are dealt by conversation and sorted by turn on the way (Spark's sort spills), and a task
passes over them row by row: a conversation of any length needs memory for one turn only.  A
digest of a whole conversation can only be taken in order, so one conversation is one task's work.

* null text: empty; null role: an empty role, out of order everywhere
* turns with equal number: in order of role, then text; repeated rows are turns of their own; a null turn comes first
* null ``conv_id``: one conversation of its own
* an empty table: no conversation; other columns are ignored
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import short_batches
from tallymark.llm.textscan import chunks

#: Segments that go out at once.
SEGMENTS = 4096
START = ""


@dataclass(frozen=True)
class Template:
    """Marks, trained roles, and for each state (the role before; empty at the start) the roles that may follow."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    trained: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant"}),
        }
    )

    def __post_init__(self):
        for mark in (self.opening, self.closing):
            if not re.match(r"<\|[^\\|<>]+\|>\n?\Z", mark):
                raise ValueError("a mark is <|name|>, and may end its line")
        if self.after_role != "\n":
            raise ValueError("a role ends with its line")

    def step(self, state: str, role: str) -> bool:
        """Whether ``role`` may follow; the role is the next state either way."""
        return role in self.follows.get(state, frozenset())


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """A role stands on one line: line feeds and backslashes in it are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


SEGMENT = "conv_id long, n long, in_order boolean, part string, text string, loss boolean"


def _segments(template: Template):
    """``(conv_id, n, in_order, part, text, loss)``: the parts of turn ``n`` are open, text and close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no conversation yet
        state, n = START, 0
        for batch in chunks(batches, "text"):
            rows: list[tuple] = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != current:
                    current, state, n = conv, START, 0
                role = role or ""
                fits = template.step(state, role)
                state = role
                rows.append((conv, n, fits, "open", template.opening + escape_role(role) + template.after_role, False))
                rows.append((conv, n, fits, "text", escape(text or ""), role in template.trained))
                rows.append((conv, n, fits, "close", template.closing, False))
                n += 1
            for a in range(0, len(rows), SEGMENTS):
                yield _batch(rows[a : a + SEGMENTS])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SEGMENT.split(", ")])


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Segments of all conversations of ``turns (conv_id, turn, role, text)``; those of one stand in order in one partition.

    Joined in order they are the formatted conversation, ready to be tokenised with a loss mask.
    """
    short_batches(turns.sparkSession)
    return (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_segments(template), SEGMENT)
    )


class Reader:
    """Reads formatted text back, piece by piece, into turns; it knows the template alone."""

    def __init__(self, template: Template):
        self.mark = re.compile(f"({re.escape(template.opening)})|({re.escape(template.closing)})")
        self.opening, self.closing, self.after = template.opening, template.closing, template.after_role
        self.rest, self.role = "", None

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """``(role, text)`` of every turn that is complete now."""
        self.rest += piece
        while True:
            if self.role is None:
                end = self.rest.find(self.after, len(self.opening))
                if not self.rest.startswith(self.opening) or end < 0:
                    return
                self.role = unescape_role(self.rest[len(self.opening) : end])
                self.rest = self.rest[end + len(self.after) :]
            end = self.rest.find(self.closing)
            if end < 0:
                return
            yield self.role, unescape(self.rest[:end])
            self.rest, self.role = self.rest[end + len(self.closing) :], None


class _Digest:
    def __init__(self, template: Template):
        self.reader, self.turns, self.loss = Reader(template), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = self.out_of_order = 0
        self.covered: list[str] = []

    def add(self, part: str, text: str, loss: bool, fits: bool) -> None:
        self.formatted += len(text)
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        for role, said in self.reader.feed(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        self.out_of_order += part == "open" and not fits

    def row(self, conv: int | None) -> tuple:
        if self.reader.rest or self.reader.role is not None:
            raise ValueError(f"conversation {conv} does not read back")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.out_of_order == 0


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


def _read_back(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        names = [f.split()[0] for f in READ_BACK.split(", ")]
        done: list[tuple] = []
        current, digest = None, None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "in_order", "part", "text", "loss"))
            for conv, fits, part, text, loss in zip(*columns, strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append(digest.row(current))
                    current, digest = conv, _Digest(template)
                digest.add(part, text, loss, fits)
            if len(done) >= SEGMENTS:
                yield out()
        if digest is not None:
            done.append(digest.row(current))
        if done:
            yield out()

    return run


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row per conversation of :func:`segments`, taken from the formatted text and its loss flags."""
    return formatted.mapInArrow(_read_back(template), READ_BACK)
