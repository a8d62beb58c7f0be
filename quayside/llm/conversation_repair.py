"""Conversation structure repair by weighted CYK interval parsing (operator 11).

A conversation is sound if its role initials read ``(s?(ua)+)?``. The repair
grammar derives from a sound reading whatever edits make of it: each row is
kept, given the role user or assistant, or deleted, and rows may be inserted
anywhere. Its nonterminals are pairs of places in the sound reading (before
it, after s, after u, after a): ``XY`` derives every span of rows that some
edits turn into a reading that leads from X to Y. In Chomsky normal form the
binary rules are ``XZ -> XY YZ``, the terminal rules are the edits of one row.
Insertions are closed into the cells of single rows, on both sides, so every
rule application has them.

A cell holds the cheapest (cost, audit); the audit has an initial for every
edit, in order (K, R, D, I), and ties go to the least in ASCII. Two audits of
one span with one cost never have one as the other's prefix (what follows
could only be insertions, which cost), so the least parts make the least whole.

Cells are combined bottom-up by the length of the span: all spans and splits
of :data:`BLOCK` rows, then spans of whole blocks by doubling. The rules hold for
every split, and each split of a span gives the same cell, so the longer spans need but one.
Therefore a long conversation is parsed by many tasks: rows are dealt by
ranges of (conversation, turn), each task parses what it has of a
conversation, and these spans are combined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
BLOCK = 16

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Cheapest insertions from place to place (only user and assistant are inserted).
INSERTIONS = {(x, x): 0 for x in range(4)} | {(BEGIN, USER): 1, (BEGIN, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2,
                                             (USER, ASSISTANT): 1, (ASSISTANT, USER): 1}
PAIRS = [(BEGIN, BEGIN), (BEGIN, SYSTEM), (BEGIN, USER), (BEGIN, ASSISTANT), (SYSTEM, SYSTEM), (SYSTEM, USER), (SYSTEM, ASSISTANT),
         (USER, USER), (USER, ASSISTANT), (ASSISTANT, ASSISTANT), (ASSISTANT, USER)]
INDEX = {pair: k for k, pair in enumerate(PAIRS)}
RULES = [(INDEX[x, z], INDEX[x, y], INDEX[y2, z]) for x, y in PAIRS for y2, z in PAIRS if y == y2]
#: The start symbol derives nothing at all, or a whole sound reading.
START = (INDEX[BEGIN, BEGIN], INDEX[BEGIN, ASSISTANT])
Cell = tuple  # (cost, audit) or None, by PAIRS

ROW = "conv_id bigint, turn bigint, digest string, initial string, blank boolean, truncated boolean, copies bigint, repeated boolean"
SPAN = ("conv_id bigint, part int, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
        "least bigint, most bigint, distinct bigint, first_turn bigint, last_turn bigint, costs array<bigint>, audits array<string>")
PLAN = ("conv_id bigint, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


# --- the parser -------------------------------------------------------------------

@lru_cache(maxsize=None)
def row_cell(initial: str, faulty: bool, truncated: bool) -> Cell:
    """The cell of one row: its edits, closed under insertions on both sides."""
    edits: dict[tuple[int, int], tuple[int, str]] = {(x, x): (DELETE_COST, DELETE) for x in range(4)}

    def offer(pair, cost, audit):
        edits[pair] = min(edits.get(pair, (cost, audit)), (cost, audit))

    if not faulty:
        more = TRUNCATED_COST * truncated
        for (x, symbol), y in STEP.items():
            if symbol == initial:
                offer((x, y), more, KEEP)
            if symbol != "s":
                offer((x, y), REROLE_COST + more, REROLE)
    out = [None] * len(PAIRS)
    for (a, x), before in INSERTIONS.items():
        for (y, b), after in INSERTIONS.items():
            if (x, y) in edits and (a, b) in INDEX:
                cost, audit = edits[x, y]
                found = (cost + INSERT_COST * (before + after), INSERT * before + audit + INSERT * after)
                k = INDEX[a, b]
                out[k] = min(out[k] or found, found)
    return tuple(out)


def join_cells(left: Cell, right: Cell, best: list | None = None) -> list:
    """Every binary rule over one split, into ``best``."""
    best = [None] * len(PAIRS) if best is None else best
    for target, a, b in RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        cost, known = x[0] + y[0], best[target]
        if known is None or cost < known[0]:
            best[target] = (cost, x[1] + y[1])
        elif cost == known[0]:
            best[target] = min(known, (cost, x[1] + y[1]))
    return best


def parse_block(rows: list[Cell]) -> Cell:
    """CYK over all spans of some rows, by length, each with all its splits; the cell of the whole."""
    n = len(rows)
    chart = {(i, i + 1): rows[i] for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best = None
            for k in range(i + 1, i + length):
                best = join_cells(chart[i, k], chart[k, i + length], best)
            chart[i, i + length] = tuple(best)
    return chart[0, n]


class Span:
    """What one task has of a conversation, row by row in order, and the parse of it so far."""

    def __init__(self):
        self.rows: list[Cell] = []
        self.done: list[tuple[int, Cell]] = []  # (blocks, cell): spans of falling length
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_initial = self.last_initial = self.least = self.most = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if not self.n:
            self.first_initial, self.first_turn = initial, turn
        elif self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.distinct += not self.n or turn != self.last_turn
            self.least, self.most = turn if self.least is None else self.least, turn
        self.last_initial, self.last_turn = initial, turn
        self.n += 1
        self.blank += blank
        self.duplicate += not blank and duplicate
        truncated = truncated and not blank and not duplicate
        self.truncated += truncated
        self.rows.append(row_cell(initial if initial in ("s", "u", "a") else "", blank or duplicate, truncated))
        if len(self.rows) == BLOCK:
            self.close()

    def close(self) -> None:
        """Parse the rows at hand and combine spans of one length."""
        if not self.rows:
            return
        self.done.append((1, parse_block(self.rows)))
        self.rows = []
        while len(self.done) > 1 and self.done[-1][0] == self.done[-2][0]:
            (length, right), (_, left) = self.done.pop(), self.done.pop()
            self.done.append((2 * length, tuple(join_cells(left, right))))

    def cell(self) -> Cell | None:
        self.close()
        whole = None
        for _, cell in reversed(self.done):
            whole = cell if whole is None else tuple(join_cells(cell, whole))
        return whole


def cheapest(cell: Cell | None) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; without rows there is nothing to do."""
    return (0, "") if cell is None else min(cell[k] for k in START if cell[k] is not None)


class Repair:
    """Applies an audit to the rows of a conversation in order, giving the repaired (role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.turns = audit, 0, 0

    def _next(self) -> str:
        self.turns += 1
        return "user" if self.turns % 2 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == REROLE:
            yield self._next(), text
        elif edit == KEEP:
            self.turns += role[:1] != "s"
            yield role, text


# --- the table operations ---------------------------------------------------------

def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text and ``copies`` (0: dropped, 2: repeated) of every row."""
    code = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                _text("role").alias("role"), _text("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies and ``digest``, which tells rows of one turn apart and orders them."""
    copies = F.coalesce(F.col("copies").cast("bigint"), F.lit(0)) if "copies" in turns.columns else F.lit(1).cast("bigint")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), _text("role").alias("role"),
                        _text("text").alias("text"), copies.alias("copies"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.md5(whole.cast("binary")))


def faults(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number and faults, without texts; ``repeated``: its role and text stand in an earlier turn.

    Equal rows of one turn become one with a count, so a row that occurs any number of times is one row.
    """
    bare = F.btrim("text", F.lit(SPACE))
    rows = _plain(turns).select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
                                (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
    rows = stored(rows.groupBy("conv_id", "turn", "digest", "initial", "blank", "truncated").agg(F.sum("copies").alias("copies")), "rows")
    seen = (rows.where("copies > 0").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("turns"))
            .where("turns > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    repeated = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    return rows.join(seen, same, "left").select(*[f.split()[0] for f in ROW.split(", ")[:-1]], repeated.alias("repeated"))


def spans(rows: DataFrame) -> DataFrame:
    """The parse of each task's part of each conversation; rows go to the tasks by ranges of conversation and turn."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, conv, span = TaskContext.get().partitionId(), [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if span is None or r["conv_id"] != conv:
                    if span is not None:
                        out.append(_span_row(conv, part, span))
                    conv, span = r["conv_id"], Span()
                for copy in range(r["copies"]):
                    span.add(r["turn"], r["initial"], r["blank"], r["repeated"] or copy > 0, r["truncated"])
            if len(out) >= 500:
                yield _batch(out, SPAN)
                out = []
        if span is not None:
            out.append(_span_row(conv, part, span))
        if out:
            yield _batch(out, SPAN)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(parse, SPAN)


def _span_row(conv: int | None, part: int, span: Span) -> tuple:
    cell = span.cell()
    return (conv, part, span.n, span.blank, span.duplicate, span.truncated, span.illegal, span.first_initial, span.last_initial, span.least, span.most,
            span.distinct, span.first_turn, span.last_turn, None if cell is None else [c and c[0] for c in cell],
            None if cell is None else [c and c[1] for c in cell])


TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, TYPES[kind]) for column, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def plans(parsed: DataFrame) -> DataFrame:
    """The counts and the cheapest (cost, audit) of every conversation: its spans, combined in order."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                r["cell"] = None if r["costs"] is None else tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"]))
                if whole is not None and whole["conv_id"] == r["conv_id"]:
                    whole = _join_spans(whole, r)
                    continue
                if whole is not None:
                    out.append(_plan_row(whole))
                whole = r
            if len(out) >= 1000:
                yield _batch(out, PLAN)
                out = []
        if whole is not None:
            out.append(_plan_row(whole))
        if out:
            yield _batch(out, PLAN)

    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(combine, PLAN)


def _join_spans(a: dict, b: dict) -> dict:
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
    out["distinct"] -= b["first_turn"] is not None and a["last_turn"] == b["first_turn"]
    out |= {"conv_id": a["conv_id"], "first_initial": a["first_initial"], "last_initial": b["last_initial"], "first_turn": a["first_turn"],
            "last_turn": b["last_turn"], "least": b["least"] if a["least"] is None else a["least"], "most": b["most"],
            "cell": tuple(join_cells(a["cell"], b["cell"]))}
    return out


def _plan_row(r: dict) -> tuple:
    gaps = 0 if r["least"] is None else r["most"] - r["least"] + 1 - r["distinct"]
    cost, audit = cheapest(r["cell"])
    return r["conv_id"], r["n"], gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], cost, audit


def _with_plans(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """Per conversation its audit and then its rows in order, in one task, which reads them as a stream."""
    rows = _plain(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text", "copies")
    none = F.lit(None).cast("string")
    heads = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), none.alias("digest"), none.alias("role"),
                           F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("copies"))
    both = heads.unionByName(rows)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "digest").select(
        "conv_id", "kind", "role", "text", "copies")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]] | None]]:
    """(conversation, some of its repaired rows in order); None when a conversation begins."""
    conv, work = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if not r["kind"]:
                if work is not None:
                    yield conv, work.inserted()
                conv, work = r["conv_id"], Repair(r["text"])
                yield conv, None
            else:
                for _ in range(r["copies"]):
                    yield conv, work.row(r["role"], r["text"])
    if work is not None:
        yield conv, work.inserted()


def repaired_rows(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text of the repaired conversations."""
    schema = "conv_id bigint, position bigint, role string, text string"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position, held = [], 0, 0
        for conv, rows in _repaired(batches):
            if rows is None:
                position = 0
                continue
            for role, text in rows:
                out.append((conv, position, role, text))
                position, held = position + 1, held + len(text)
            if len(out) >= 1000 or held > 1 << 22:
                yield _batch(out, schema)
                out, held = [], 0
        if out:
            yield _batch(out, schema)

    return _with_plans(turns, planned).mapInArrow(emit, schema)


def repaired_hashes(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, ``repaired_sha256`` of the repaired ``role:text`` rows, joined by newlines; texts pass through as a stream."""
    schema = "conv_id bigint, repaired_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, state, empty = [], None, None, True
        for conv, rows in _repaired(batches):
            if rows is None:
                if state is not None:
                    out.append((current, state.hexdigest()))
                    if len(out) >= 1000:
                        yield _batch(out, schema)
                        out = []
                current, state, empty = conv, hashlib.sha256(), True
                continue
            for role, text in rows:
                state.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
                empty = False
        if state is not None:
            out.append((current, state.hexdigest()))
        if out:
            yield _batch(out, schema)

    return _with_plans(turns, planned).mapInArrow(digest, schema)


def repair_plans(turns: DataFrame) -> DataFrame:
    """Per conversation: n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit; written to shared scratch.

    ``turns`` has conv_id, turn, role, text and, if rows are to count several
    times or not at all, ``copies``; other columns are ignored. A null role or
    text is one space. Rows go by turn, nulls first, and in one turn by a hash
    of role and text; equal rows follow each other, so all but the first are
    duplicates. A null conv_id is a conversation like any other. An empty role
    or one that begins with another letter cannot be kept as it is. A
    conversation without rows (all have 0 copies) has zeros and an empty audit;
    an empty table gives no rows.
    """
    return stored(plans(stored(spans(faults(turns)), "spans")), "plans")


def repair(turns: DataFrame) -> DataFrame:
    """:func:`repair_plans` with the hash of each repaired conversation."""
    planned = repair_plans(turns)
    hashes = repaired_hashes(turns, planned).withColumnRenamed("conv_id", "c")
    return (planned.join(hashes, planned["conv_id"].eqNullSafe(hashes["c"]))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_rows"))
