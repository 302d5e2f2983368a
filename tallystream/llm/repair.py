"""Operator 12: repair of conversation structure by weighted CYK interval parsing.

A repaired conversation is empty or has role initials s?(ua)+. The repair grammar is in Chomsky normal form. Its symbols
are pairs <p q> of states of the automaton for these initials; <p q> derives what leads from p to q:

    <p q> -> <p r> <r q>
    <p q> -> row       kept, if its initial leads from p to q; given another role, if u or a does; deleted, if p = q

A cell holds, for every symbol, the least (cost, audit) with which the rows of a span derive it; the audit is the edits'
initials in order. Insertions derive the empty span; their closure is put around every row, and since the closure followed by
itself is itself, combining closed cells gives closed ones. Cells are combined bottom-up by span length. The
symbols of a span's two parts meet in any state r, so every place to split a span gives the same cell; of all spans
only those of a binary tree are formed, and a conversation of n rows costs n - 1 combinations. The least audit of a part is
always part of a least whole: among audits of one span and cost none is the beginning of another.

Rows are cut into blocks of turns, whose cells are found apart, so a very long conversation is spread. The repaired rows of a conversation
are then written in one sorted stream, which keeps no text; only its duplicate marks and block cells, not its texts, are shuffled
before. Texts go through one shuffle.

Rows are taken by turn (null first); rows of one turn, for which no order is given, by the md5 of role and text. Of a row the first fault
counts: blank, duplicate (role and text seen earlier), truncated (the last character that is no blank is none of .!?).

Defined results: a null role or text is one space; null is a conversation id like any other; repeated rows are duplicates; a conversation
without rows gives zeros and an empty audit; an empty table gives no rows; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallystream.llm.shared import BLANKS

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
TURN_BITS = 10  # a block holds the rows of 2^10 consecutive turns
BLOCK_ROWS = 4096  # and no more rows than this

# The automaton of s?(ua)+, with 0 also an end because an empty conversation is allowed.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = 4, (0, 3)
ROLES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]

# ---- grammar --------------------------------------------------------------------------------


def _better(cell: Cell, symbol: tuple[int, int], value: tuple[int, str]) -> None:
    if symbol not in cell or value < cell[symbol]:
        cell[symbol] = value


def _insertions() -> Cell:
    """The closure of insertions: what an empty span derives."""
    cell: Cell = {(p, p): (0, "") for p in range(STATES)}
    for _ in range(STATES):
        for (p, q), (cost, audit) in list(cell.items()):
            for role in ROLES:
                if (q, role) in STEPS:
                    _better(cell, (p, STEPS[q, role]), (cost + INSERT, audit + "I"))
    return cell


def _reached() -> list[tuple[int, int]]:
    """All symbols that derive anything."""
    found = {(p, p) for p in range(STATES)}
    for _ in range(STATES):
        found |= {(p, to) for p, q in found for (source, _), to in STEPS.items() if source == q}
    return sorted(found)


SYMBOLS = _reached()
RULES = [((p, q), (p, r), (r, q)) for p, q in SYMBOLS for r in range(STATES) if (p, r) in SYMBOLS and (r, q) in SYMBOLS]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for symbol, a, b in RULES:
        if a in left and b in right:
            x, y = left[a], right[b]
            _better(out, symbol, (x[0] + y[0], x[1] + y[1]))
    return out


EMPTY = _insertions()


def row_cell(initial: str, fault: str | None) -> Cell:
    """The closed cell of one row."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(STATES)}
    if fault in (None, "truncated"):
        extra = TRUNCATED if fault else 0
        for (p, role), q in STEPS.items():
            if role == initial:
                _better(cell, (p, q), (KEEP + extra, "K"))
            if role in ROLES:
                _better(cell, (p, q), (REROLE + extra, "R"))
    return combined(combined(EMPTY, cell), EMPTY)


class Spans:
    """Cells of neighbouring spans added from left to right, combined as soon as two of one length stand side by side."""

    def __init__(self):
        self.open: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        size = 1
        while self.open and self.open[-1][0] == size:
            cell = combined(self.open.pop()[1], cell)
            size *= 2
        self.open.append((size, cell))

    def whole(self) -> Cell:
        found = None
        for _, cell in reversed(self.open):
            found = cell if found is None else combined(cell, found)
        return EMPTY if found is None else found


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the best repair of a whole conversation."""
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


# ---- blocks ---------------------------------------------------------------------------------

_BLOCK = (
    "conv_id long, chunk long, seq int, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "least long, most long, turns long, costs array<long>, audits array<string>")
_BLOCK_TYPES = pa.schema([
    ("conv_id", pa.int64()), ("chunk", pa.int64()), ("seq", pa.int32()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()),
    ("most", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
LEGAL = {"su", "ua", "au"}


class _Block:
    """What is known of the rows of one block so far."""

    def __init__(self, conv_id: int | None, chunk: int | None, seq: int):
        self.key, self.n, self.spans = (conv_id, chunk, seq), 0, Spans()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.first, self.last = 0, "", ""
        self.least = self.most = None
        self.turns = 0

    def add(self, initial: str, fault: str | None, turn: int | None, new_turn: bool, cell: Cell) -> None:
        if fault:
            self.faults[fault] += 1
        if not self.n:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += new_turn
        self.n += 1
        self.spans.add(cell)

    def row(self) -> dict:
        cell = self.spans.whole()
        return {
            **dict(zip(("conv_id", "chunk", "seq"), self.key)), **self.faults, "illegal": self.illegal, "first": self.first, "last": self.last,
            "least": self.least, "most": self.most, "turns": self.turns,
            "costs": [cell[s][0] if s in cell else None for s in SYMBOLS], "audits": [cell[s][1] if s in cell else None for s in SYMBOLS]}


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block from rows sorted by conversation and place."""
    cells: dict[tuple[str, str | None], Cell] = {}
    block, turn_before, out = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "chunk", "turn", "initial", "fault")]
        for conv_id, chunk, turn, initial, fault in zip(*columns):
            key = (initial if (0, initial) in STEPS or initial in ROLES else "", fault)
            if key not in cells:
                cells[key] = row_cell(*key)
            if block is None or block.key[:2] != (conv_id, chunk):
                if block:
                    out.append(block.row())
                block, turn_before = _Block(conv_id, chunk, 0), None
            elif block.n == BLOCK_ROWS:
                out.append(block.row())
                block = _Block(conv_id, chunk, block.key[2] + 1)
            block.add(initial, fault, turn, turn != turn_before, cells[key])
            turn_before = turn
        if out:
            yield pa.RecordBatch.from_pylist(out, _BLOCK_TYPES)
            out = []
    if block:
        yield pa.RecordBatch.from_pylist([block.row()], _BLOCK_TYPES)


# ---- repair ---------------------------------------------------------------------------------

_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = f"conv_id long, position long, edit string, role string, text string, report struct<{_REPORT}>"
_REPORT_TYPE = pa.struct([
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string())])
_REPAIRED_TYPES = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
    ("report", _REPORT_TYPE)])


class _Report:
    """Joins the blocks of one conversation."""

    def __init__(self):
        self.spans, self.last = Spans(), None
        self.sums = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least = self.most = None
        self.turns = 0

    def add(self, block: dict) -> None:
        for name in self.sums:
            self.sums[name] += block[name]
        if self.last is not None and self.last + block["first"] not in LEGAL:
            self.sums["illegal"] += 1
        self.last = block["last"]
        if block["least"] is not None:
            self.least = block["least"] if self.least is None else self.least
            self.most = block["most"]
        self.turns += block["turns"]
        self.spans.add({s: (c, a) for s, c, a in zip(SYMBOLS, block["costs"], block["audits"]) if c is not None})

    def row(self) -> dict:
        cost, audit = cheapest(self.spans.whole())
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, **self.sums, "cost": cost, "audit": audit}


class _Writer:
    """Walks along the audit and gives the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.position = audit, 0, 0, 0

    def _row(self, edit: str, role: str, text: str, initial: str) -> dict:
        self.state = STEPS[self.state, initial]
        self.position += 1
        return {"position": self.position, "edit": edit, "role": role, "text": text}

    def inserted(self) -> Iterator[dict]:
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            initial = "u" if (self.state, "u") in STEPS else "a"
            yield self._row("I", ROLES[initial], "", initial)

    def rows(self, role: str, text: str) -> Iterator[dict]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._row("K", role, text, role[:1])
        elif edit == "R":
            initial = "u" if (self.state, "u") in STEPS else "a"
            yield self._row("R", ROLES[initial], text, initial)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        block = zip(*[batch.column(c).to_pylist() for c in _BLOCK_TYPES.names[3:]])
        yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")], block)


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its report, as position 0, and its rows, from its blocks and then its texts in order."""
    out, held = [], 0
    for conv_id, rows in groupby(_stream(batches), key=lambda r: r[0]):
        report, writer = _Report(), None

        def begin() -> _Writer:
            done = report.row()
            out.append({"conv_id": conv_id, "position": 0, "report": done})
            return _Writer(done["audit"])

        for _, kind, role, text, block in rows:
            if kind == 1:
                report.add(dict(zip(_BLOCK_TYPES.names[3:], block)))
            elif kind == 2:
                writer = writer or begin()
                for r in writer.rows(role, text):
                    out.append({"conv_id": conv_id, **r})
                    held += len(r["text"])
                if held > 1 << 22 or len(out) > 10_000:
                    yield pa.RecordBatch.from_pylist(out, _REPAIRED_TYPES)
                    out.clear()
                    held = 0
        writer = writer or begin()
        out += [{"conv_id": conv_id, **r} for r in writer.inserted()]
    if out:
        yield pa.RecordBatch.from_pylist(out, _REPAIRED_TYPES)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, mark, initial, fault of every row (conv_id, turn, role, text): the first of its faults or null."""
    ending = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    marked = rows.select("conv_id", "turn", _mark(), F.substring("role", 1, 1).alias("initial"), ending.alias("ending"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = (
        F.when(F.col("ending") == "", "blank").when(F.col("seen"), "duplicate")
        .when(~F.col("ending").isin(".", "!", "?"), "truncated"))
    return marked.withColumn("seen", seen).select("conv_id", "turn", "mark", "initial", fault.alias("fault"))


def _mark() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("mark")


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Repaired conversations: conv_id, position, edit, role, text, report.

    Position 0 of a conversation holds its report (gaps, faults, illegal neighbours, cost, audit), the others its rows after
    repair in order. `ids` adds conversations that have no rows. Partitions hold whole conversations in order.
    """
    own = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    chunk = F.shiftright("turn", TURN_BITS).alias("chunk")
    place = [F.asc_nulls_first("chunk"), F.asc_nulls_first("turn"), "mark"]
    blocks = (
        faults(rows).withColumn("chunk", chunk).repartition("conv_id", "chunk")
        .sortWithinPartitions("conv_id", *place).mapInArrow(_block_rows, _BLOCK))
    texts = rows.select(*own, chunk, _mark(), F.lit(2).alias("kind"))
    ids = rows.select("conv_id") if ids is None else ids.select(F.col("conv_id").cast("long").alias("conv_id"))
    stream = (
        ids.distinct().withColumn("kind", F.lit(0))
        .unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(texts, allowMissingColumns=True))
    return (
        stream.repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("chunk"), "seq", F.asc_nulls_first("turn"), "mark")
        .select("conv_id", "kind", "role", "text", *_BLOCK_TYPES.names[3:])
        .mapInArrow(_repaired_rows, REPAIRED))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without .!?, repeated, or of role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")
    ).drop("_copy")


def report_digests(repaired: DataFrame) -> DataFrame:
    """The report of every conversation and the SHA-256 of its repaired rows, read in order where `repair` left them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _REPORT_TYPE]
        kinds = pa.schema([("conv_id", pa.int64()), *[(f.name, f.type) for f in _REPORT_TYPE], ("repaired_sha256", pa.string())])
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text", "report")]))
        out = []
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            report, sha = next(own)[4], hashlib.sha256()
            for _, position, role, text, _ in own:
                sha.update(f"{chr(10) if position > 1 else ''}{role}:{text}".encode())
            out.append({"conv_id": conv_id, **{n: report[n] for n in names}, "repaired_sha256": sha.hexdigest()})
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return repaired.mapInArrow(digest, f"conv_id long, {_REPORT}, repaired_sha256 string")
