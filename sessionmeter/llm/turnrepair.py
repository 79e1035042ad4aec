"""Repair of conversation structure by weighted CYK interval parsing.

A well-formed conversation has roles whose initials give ``(s?(ua)+)?``. Rows are kept (0), given
the role user or assistant (3) or deleted (4, required for blank and duplicate rows); a user or
assistant row with empty text may be inserted anywhere (3); a truncated row that is not deleted adds 3.

The grammar is in Chomsky normal form: nonterminal [p, q] stands for all edits that take the role
pattern from state p to state q, with productions [p, q] -> [p, r] [r, q]. A span of rows has one cell per
nonterminal, its least (cost, audit). A single row's cells hold its edits behind the insertion closure (any
insertions in front of it); longer spans are combined bottom-up by length from two neighbours. As the
nonterminals name every state that can lie between, all splits of a span give the same strings, and one
of them is computed: a conversation of n rows takes n combinations. Two audits of one cell with equal
cost never are prefix of each other (they edit the same rows, so the longer one has more insertions), so
least parts give least wholes.

Rows are shuffled by conversation and sorted, first without and then with their text: a task reads the one
byte that parsing needs of each row, then the texts one after the other. No conversation's texts are held
together, and equal rows of one turn travel as one row with their number. What grows with a
conversation is its audit, a part of the result. Its hash needs the texts in order, so one task reads them.

Nulls count as one space (a null turn comes first); a null conv_id is a conversation of its own. Rows with equal turns
come by role, then by a digest of the text. Rows that repeat are duplicates. An empty table gives an empty one,
conversations whose rows are all dropped stay with zeros, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NO_FAULT, BLANK, DUPLICATE, CUT_OFF = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: The role pattern: state and initial to state; 0 is the beginning, 3 follows an assistant row.
NEXT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
STATES, ACCEPTED = range(4), (0, 3)
ROLES = {USER: "user", ASSISTANT: "assistant"}

#: Per first state: last state to (cost, audit).
Cells = list[dict[int, tuple[int, bytes]]]


def _combined(left: Cells, right: Cells) -> Cells:
    out: Cells = []
    for p in STATES:
        best: dict[int, tuple[int, bytes]] = {}
        for r, (cost, audit) in left[p].items():
            for q, (more, rest) in right[r].items():
                new = (cost + more, audit + rest)
                if q not in best or new < best[q]:
                    best[q] = new
        out.append(best)
    return out


def _insertions() -> Cells:
    """Insertion closure of the empty span."""
    closed: Cells = [{p: (0, b"")} for p in STATES]
    step: Cells = [{q: (INSERT, b"I") for role in ROLES if (q := NEXT.get((p, role))) is not None} for p in STATES]
    while True:
        longer = _combined(closed, step)
        wider = [{q: min(c[q] for c in (a, b) if q in c) for q in a | b} for a, b in zip(closed, longer)]
        if wider == closed:
            return closed
        closed = wider


CLOSURE = _insertions()


@lru_cache(maxsize=16)
def _row(code: int) -> Cells:
    """Cells of one row, given as initial times 4 plus fault."""
    initial, fault = divmod(code, 4)
    cells: Cells = []
    for p in STATES:
        edits = [(p, (DELETE, b"D"))]
        if fault in (NO_FAULT, CUT_OFF):
            extra = TRUNCATED if fault == CUT_OFF else 0
            edits += [(NEXT.get((p, role)), (REROLE + extra, b"R")) for role in ROLES]
            edits.append((NEXT.get((p, initial)), (KEEP + extra, b"K")))
        best: dict[int, tuple[int, bytes]] = {}
        for q, cell in edits:
            if q is not None and (q not in best or cell < best[q]):
                best[q] = cell
        cells.append(best)
    return _combined(CLOSURE, cells)


def _parsed(spans: list[Cells]) -> Cells:
    while len(spans) > 1:
        joined = [_combined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = joined + spans[2 * len(joined):]
    return spans[0]


#: Rows of a span whose cells are remembered by the worker.
SHORT = 8


@lru_cache(maxsize=20_000)
def _short(codes: bytes) -> Cells:
    return _parsed([_row(c) for c in codes])


def cheapest(codes: bytes) -> tuple[int, bytes]:
    """Least (cost, audit) of a conversation's rows, each one byte."""
    if not codes:
        return 0, b""
    whole = _combined(_parsed([_short(codes[i:i + SHORT]) for i in range(0, len(codes), SHORT)]), CLOSURE)[0]
    return min(whole[q] for q in ACCEPTED if q in whole)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the contract's damage; rows with no copies are dropped ones."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The same columns without damage."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                F.lit(1).cast("long").alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows as the tasks read them: by conversation, without text (pass 0), then with it (pass 1)."""
    # Equal rows of a turn become one before the shuffle.
    single = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
                    .withColumn("digest", F.md5("text")).withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    when = F.struct(F.col("turn").isNotNull().alias("stated"), F.col("turn").alias("turn"))
    said = single.filter("copies > 0 and not blank")
    repeated = said.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = repeated.select(*(F.col(c).alias(f"r_{c}") for c in ("conv_id", "role", "digest")), "first")
    initial = F.substring("role", 1, 1)
    marked = single.filter("copies > 0").join(
        seen, F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("role") == F.col("r_role"))
        & (F.col("digest") == F.col("r_digest")), "left").select(
        "conv_id", "turn", "role", "text", "digest", "copies",
        F.when(F.col("blank"), BLANK).when(F.coalesce(F.col("first") < when, F.lit(False)), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF).otherwise(NO_FAULT).alias("fault"),
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER).alias("initial"))
    code = (F.col("initial") * 4 + F.col("fault")).cast("int").alias("code")
    place = ("conv_id", "turn", "role", "digest")
    short = F.struct(F.lit(0).alias("pass"), F.lit(None).cast("string").alias("text"))
    whole = F.struct(F.lit(1).alias("pass"), F.col("text"))
    twice = F.when(F.col("fault").isin(NO_FAULT, CUT_OFF), F.array(short, whole)).otherwise(F.array(short))
    stream = marked.select(*place, "copies", code, F.inline(twice))
    names = single.select("conv_id").distinct().select(  # conversations that lost all rows count too
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
        F.lit(0).cast("long").alias("copies"), F.lit(0).alias("code"), F.lit(-1).alias("pass"), F.lit(None).cast("string").alias("text"))
    return stream.unionByName(names).repartition("conv_id").sortWithinPartitions(
        "conv_id", "pass", F.col("turn").asc_nulls_first(), "role", "digest")


class _Conversation:
    """One conversation while its rows pass."""

    def __init__(self, conv_id: int | None, sink):
        self.conv_id, self.sink = conv_id, sink
        self.codes = bytearray()
        self.low = self.high = None
        self.turns = 0
        self.steps = None
        sink.begin()

    def row(self, turn: int | None, code: int, copies: int) -> None:
        self.codes.append(code)
        if copies > 1:  # further copies are blank like the first, or duplicates
            initial, fault = divmod(code, 4)
            self.codes += bytes([initial * 4 + (BLANK if fault == BLANK else DUPLICATE)]) * (copies - 1)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1

    def parse(self) -> None:
        self.codes = bytes(self.codes)
        self.cost, self.audit = cheapest(self.codes)
        self.steps = self._steps()

    def _steps(self) -> Iterator[tuple[int, str | None]]:
        """Hands insertions to the sink as they come; yields code and new role of every row that can stay."""
        state, edits = 0, iter(self.audit.decode())
        for code in self.codes:
            for edit in edits:
                role = ASSISTANT if state == 2 else USER
                if edit == "I":
                    self.sink.line(self, edit, None, ROLES[role], "")
                    state = NEXT[state, role]
                    continue
                if edit == "R":
                    state = NEXT[state, role]
                elif edit == "K":
                    state = NEXT[state, code // 4]
                if code % 4 in (NO_FAULT, CUT_OFF):
                    yield edit, ROLES[role]
                break
        for edit in edits:
            role = ASSISTANT if state == 2 else USER
            self.sink.line(self, edit, None, ROLES[role], "")
            state = NEXT[state, role]

    def text(self, turn: int | None, role: str, text: str) -> None:
        if self.steps is None:
            self.parse()
        edit, other = next(self.steps)
        if edit != "D":
            self.sink.line(self, edit, turn, other if edit == "R" else role, text)

    def end(self) -> None:
        if self.steps is None:
            self.parse()
        for _ in self.steps:
            raise RuntimeError("a row came without its text")
        faults = [c % 4 for c in self.codes]
        initials = [c // 4 for c in self.codes]
        self.report = (
            self.conv_id, 0 if self.low is None else self.high - self.low + 1 - self.turns, faults.count(BLANK),
            faults.count(DUPLICATE), faults.count(CUT_OFF),
            sum(pair not in LEGAL for pair in zip(initials, initials[1:])), self.cost, self.audit.decode())
        self.sink.end(self)


class _Reports:
    """Sink for a row per conversation; the texts go into a running hash."""

    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string, repaired_sha256 string")
    types = [*[pa.int64()] * 7, pa.string(), pa.string()]

    def __init__(self):
        self.rows: list[tuple] = []

    def begin(self) -> None:
        self.hash, self.first = hashlib.sha256(), True

    def line(self, conversation: _Conversation, edit: str, turn: int | None, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def end(self, conversation: _Conversation) -> None:
        self.rows.append((*conversation.report, self.hash.hexdigest()))


class _Rows:
    """Sink for the repaired rows."""

    schema = "conv_id long, place long, edit string, turn long, role string, text string"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def __init__(self):
        self.rows: list[tuple] = []

    def begin(self) -> None:
        self.place = 0

    def line(self, conversation: _Conversation, edit: str, turn: int | None, role: str, text: str) -> None:
        self.rows.append((conversation.conv_id, self.place, edit, turn, role, text))
        self.place += 1

    def end(self, conversation: _Conversation) -> None:
        pass


def _streamed(rows: DataFrame, kind: type) -> DataFrame:
    names = [part.split()[0] for part in kind.schema.split(", ")]

    def flushed(sink) -> Iterator[pa.RecordBatch]:
        if sink.rows:
            columns = zip(*sink.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], names=names)
            sink.rows = []

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, now = kind(), None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "pass", "turn", "role", "code", "copies", "text")]
            for conv_id, phase, turn, role, code, copies, text in zip(*columns, strict=True):
                if phase < 0:
                    if now:
                        now.end()
                    now = _Conversation(conv_id, sink)
                elif phase == 0:
                    now.row(turn, code, copies)
                else:
                    now.text(turn, role, text)
            yield from flushed(sink)
        if now:
            now.end()
        yield from flushed(sink)

    return _ordered(rows).mapInArrow(work, kind.schema)


def reports(rows: DataFrame) -> DataFrame:
    """A row per conversation: faults, cost and audit of its repair, hash of the repaired text."""
    return _streamed(rows, _Reports)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place, edit (K, R or I), turn, role, text."""
    return _streamed(rows, _Rows)


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return reports(damaged(conversations))
