"""Least-cost repair of the turns of conversations, streamed in turn order.

Rows are dealt by conversation, repeats are marked there by a window, and each task reads
its conversations in turn order. A dynamic program over four states (nothing yet, after a
system turn, after a user turn, after an assistant turn) is carried across Arrow batches;
a row leaves four bytes, the step by which each state is best reached. Steps and texts of
a conversation that outgrows ``SPOOL`` bytes go to a file of the task in the folder where
Spark itself spills, so a conversation of any length needs little memory besides its audit.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from gaugeline.llm.support import ship

SPOOL = 8 << 20
OUT_BYTES = 4 << 20
OUT_ROWS = 4096
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
ROLES = {2: "user", 3: "assistant"}

START, SYSTEM, USER, ASSISTANT = range(4)
# The state an added, or newly named, turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
# What a row allows: keep by its first letter, any other letter, or only deletion.
KINDS = {"s": 0, "u": 1, "a": 2}
ROLE_KINDS = {1: USER, 2: ASSISTANT}
OTHER, DELETE = 3, 4
EDITS = "DIKR"
# States this much dearer than the cheapest can never be part of a cheapest repair: two
# added turns and one deletion (7) make up for any difference between states.
HOPELESS = 16


def _steps() -> list[list[tuple[int, int, int, str, int]]]:
    """Per kind of row: (from, turns added, to, edits, cost without truncation)."""
    out = []
    for kind in range(5):
        steps = []
        for begin in range(4):
            state = begin
            for added in range(3):
                before, cost = "I" * added, 2 * added
                steps.append((begin, added, state, before + "D", cost + 3))
                if kind != DELETE:
                    steps.append((begin, added, NEXT[state], before + "R", cost + 2))
                if (kind == 0 and state == START) or (kind in ROLE_KINDS and NEXT[state] == ROLE_KINDS[kind]):
                    steps.append((begin, added, NEXT[state] if kind else SYSTEM, before + "K", cost))
                state = NEXT[state]
        out.append(steps)
    return out


STEPS = _steps()
# An audit ends in the empty sequence or after an assistant turn: (state, turns added).
ENDS = ((START, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2), (START, 2))


class Program:
    """Costs of the states after a row and the ASCII order of their cheapest edits.

    Among equal costs the edits that come first win. Edits that end in a row's own edit are
    never prefixes of each other, so their order after the next row follows from their order
    now; only finitely many differences of cost occur, so steps are looked up.
    """

    known: dict = {}

    def __init__(self):
        self.base, self.state = 0, ((0, 0), None, None, None)

    def step(self, kind: int, truncated: bool) -> bytes:
        key = (self.state, kind, truncated)
        if key not in self.known:
            self.known[key] = self._work(*key)
        more, self.state, back = self.known[key]
        self.base += more
        return back

    @staticmethod
    def _work(state, kind: int, truncated: bool):
        best: list = [None] * 4
        for begin, added, to, edits, cost in STEPS[kind]:
            if state[begin] is None:
                continue
            left = truncated and not edits.endswith("D")
            found = (state[begin][0] + cost + left, state[begin][1], edits, begin, added)
            if best[to] is None or found < best[to]:
                best[to] = found
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] <= least + HOPELESS else None for b in best]
        order = sorted(b[1:3] for b in best if b)
        after = tuple((b[0] - least, order.index(b[1:3])) if b else None for b in best)
        back = bytes((b[3] | b[4] << 2 | EDITS.index(b[2][-1]) << 4) if b else 0 for b in best)
        return least, after, back

    def end(self) -> tuple[int, int, int]:
        """Cost of the whole repair, the last state and the turns added at the end."""
        found = [(self.state[s][0] + 2 * n, self.state[s][1], "I" * n, s, n) for s, n in ENDS if self.state[s]]
        cost, _, _, state, added = min(found)
        return self.base + cost, state, added


def _spool() -> tempfile.SpooledTemporaryFile:
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return tempfile.SpooledTemporaryFile(max_size=SPOOL, dir=folders[0] if folders else None)


class Conversation:
    """One conversation while its rows pass by."""

    def __init__(self, conv):
        self.conv, self.program = conv, Program()
        self.rows = self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.steps, self.texts = _spool(), _spool()

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        core = text.rstrip(BLANKS)
        blank, cut = not core, bool(core) and core[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut and not repeated
        initial = role[:1]
        self.illegal += self.rows > 0 and self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        gone = blank or repeated
        self.steps.write(self.program.step(DELETE if gone else KINDS.get(initial, OTHER), cut and not gone))
        name, body = role.encode(), text.encode()
        self.texts.write(struct.pack("<?qqq", turn is None, turn or 0, len(name), len(body)) + name + body)
        self.rows += 1

    def audit(self) -> tuple[int, str]:
        """Cost and edits of the cheapest repair, read back from the last row to the first."""
        cost, state, added = self.program.end()
        edits = bytearray(b"I" * added)
        at = self.steps.tell()
        while at:
            size = min(at, 1 << 20)
            at -= size
            self.steps.seek(at)
            block = self.steps.read(size)
            for k in range(size - 4, -4, -4):
                code = block[k + state]
                edits.append(ord(EDITS[code >> 4]))
                edits += b"I" * (code >> 2 & 3)
                state = code & 3
        edits.reverse()
        return cost, edits.decode()

    def repaired(self, edits: str) -> Iterator[tuple[str, int | None, str, str]]:
        """Every edit with the turn, role and text it leaves; a deleted row leaves its own."""
        self.texts.seek(0)
        state = START
        for edit in edits:
            turn, role, text = None, None, ""
            if edit != "I":
                no_turn, turn, a, b = struct.unpack("<?qqq", self.texts.read(25))
                turn = None if no_turn else turn
                role, text = self.texts.read(a).decode(), self.texts.read(b).decode()
            if edit != "D":
                state = SYSTEM if edit == "K" and role[0] == "s" else NEXT[state]
                role = role if edit == "K" else ROLES[state]
            yield edit, turn, role, text

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.distinct

    def close(self) -> None:
        self.steps.close()
        self.texts.close()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """Finished conversations, one at a time; batches may begin and end anywhere."""
    now = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "absent", "repeated")]
        for conv, turn, role, text, absent, repeated in zip(*columns):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now
                    now.close()
                now = Conversation(conv)
            if not absent:
                now.add(turn, role, text, repeated)
    if now is not None:
        yield now
        now.close()


def _ordered(conversations: DataFrame, absent: str | None, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows dealt by conversation and sorted by turn; one shuffle serves window and sort."""
    gone = F.coalesce(F.col(absent).cast("boolean"), F.lit(False)) if absent else F.lit(False)
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv_id).alias("conv"), F.when(~gone, F.col(turn).cast("long")).alias("turn"),
        F.when(gone, "").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(gone, "").otherwise(F.coalesce(F.col(text), space)).alias("text"), gone.alias("absent"),
    )
    # With adaptive execution on, explicit keys alone let small partitions be joined.
    dealt = rows.repartition("conv")
    seen = Window.partitionBy("conv", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = dealt.withColumn("repeated", F.row_number().over(seen) > 1)
    return marked.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "repeated")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _emit(rows: Iterator[tuple], schema: StructType, arrow: pa.Schema, cost) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += cost(row)
        if size >= OUT_BYTES or len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], arrow)


def repair_report(
    conversations: DataFrame, absent: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Faults and cheapest repair of every conversation.

    A conversation is right when the first letters of its roles read ``(s?(ua)+)?``. A row's
    first fault counts: blank, duplicate (role and text of an earlier row), truncated (no
    ``.``, ``!`` or ``?`` at its end). Keeping a row costs 0, naming it user or assistant 2,
    deleting it 3 (a must for blank and duplicate rows), adding a turn without text 2, and a
    truncated row that stays 1. Among equally cheap edits those first in ASCII order are taken.

    Returns ``conv_id``, ``gaps`` (missing turn numbers), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (neighbouring roles that may not follow each other), ``cost``,
    ``audit`` (first letters of the edits) and ``repaired_sha256`` of the repaired
    ``role:text`` lines. Null roles and texts are one space; null turns come first and leave
    no gaps; rows of one turn are ordered by role and text; repeated rows are duplicates. A
    role without letters cannot be kept. A null id is a conversation of its own. A true value
    in the column ``absent`` marks a row that only names its conversation. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(conversations.sparkSession)
    rows = _ordered(conversations, absent, conv_id, turn, role, text)
    schema = StructType([StructField("conv_id", rows.schema["conv"].dataType), *[StructField(c, LongType()) for c in REPORT],
                         StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for c in _conversations(batches):
                cost, edits = c.audit()
                digest, first = hashlib.sha256(), True
                for edit, _, name, body in c.repaired(edits):
                    if edit != "D":
                        digest.update(f"{'' if first else chr(10)}{name}:{body}".encode())
                        first = False
                yield c.conv, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, edits, digest.hexdigest()

        yield from _emit(lines(), schema, arrow, lambda r: 200 + len(r[7]))

    return rows.mapInArrow(report, schema)


def repaired_rows(
    conversations: DataFrame, absent: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The cheapest repair of every conversation as rows, by the rules of ``repair_report``.

    Returns ``conv_id``, ``position`` (of the edit, from 0), ``edit`` (D, I, K or R), ``turn``
    (null for added rows), ``role`` and ``text``; rows with edit D are what the repair leaves out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(conversations.sparkSession)
    rows = _ordered(conversations, absent, conv_id, turn, role, text)
    schema = StructType([StructField("conv_id", rows.schema["conv"].dataType), StructField("position", LongType()),
                         StructField("edit", StringType()), StructField("turn", LongType()), StructField("role", StringType()),
                         StructField("text", StringType())])
    arrow = to_arrow_schema(schema)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for c in _conversations(batches):
                for k, (edit, at, name, body) in enumerate(c.repaired(c.audit()[1])):
                    yield c.conv, k, edit, at, name, body

        yield from _emit(lines(), schema, arrow, lambda r: 64 + len(r[5]))

    return rows.mapInArrow(repaired, schema)
