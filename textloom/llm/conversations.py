"""Repair of a conversation's structure by weighted finite-state composition.

Three machines are composed lazily: the acceptor of a conversation's rows, in order; the transducer of edits, which keeps,
re-roles or deletes a row, or inserts one; and the acceptor of the role grammar ``(s?(ua)+)?``. A state of the composition is a place
among the rows and a state of the grammar, so it has as few states at a place as the grammar has. Weights are pairs (cost, labels), the
least of which wins; places are visited in order, which is topological, as inserts that return to a state never pay.

Weights of stretches of rows can be composed too: what leads from each grammar state to each other over a stretch is a small
table. So a conversation of any length is worked on in stretches, each in a task of its own.

Rows are dealt in ranges of (conversation, turn, ...). A conversation that lies within one range is repaired where it is; those that the
borders of ranges cut, two for a range at most, go through their stretches' tables.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import settle

#: Next state of the role grammar by state and role initial.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
STATES = tuple(GRAMMAR)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, UNENDED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: Characters by which rows of a turn are first put in order.
TIE_CHARS = 64
ROWS_A_BATCH = 1000
LONGEST = (1 << 63) - 1

Weight = tuple[int, str]
Arcs = tuple[tuple[str, int, str], ...]


# ---- one conversation -----------------------------------------------------------------------------


def fault(text: str, seen_before: bool) -> str:
    """The first fault of a row: ``blank``, ``duplicate``, ``truncated`` or none."""
    shown = text.rstrip(" \t\n\v\f\r")
    return "blank" if not shown else "duplicate" if seen_before else "truncated" if shown[-1] not in ".!?" else ""


def arcs(found: str, initial: str) -> Arcs:
    """The edit transducer's arcs over a row: ``(label, cost, role initial that comes out)``."""
    deleted = ("D", DELETE, "")
    if found in ("blank", "duplicate"):
        return (deleted,)
    more = UNENDED if found == "truncated" else 0
    return (deleted, ("K", more, initial), ("R", REROLE + more, "u"), ("R", REROLE + more, "a"))


def _better(to: dict[int, Weight], state: int, weight: Weight) -> bool:
    if state in to and to[state] <= weight:
        return False
    to[state] = weight
    return True


def _with_inserts(best: dict[int, Weight]) -> dict[int, Weight]:
    """The weights at a place after any inserts there; fewer than the grammar has states are enough."""
    out, new = dict(best), list(best)
    while new:
        came = []
        for state in new:
            cost, labels = out[state]
            for initial, then in GRAMMAR[state].items():
                if initial in ROLES and _better(out, then, (cost + INSERT, labels + "I")):
                    came.append(then)
        new = came
    return out


def shortest(rows: Iterable[Arcs], start: int = 0) -> dict[int, Weight]:
    """For each grammar state that the rows can lead to from ``start`` the least (cost, labels).

    Of equally dear paths none's labels begin another's, since a longer one would have more inserts, so that the lesser labels stay
    lesser whatever follows. What all labels begin with is set aside, so that work does not grow with the square of the rows.
    """
    shared: list[str] = []
    best = _with_inserts({start: (0, "")})
    for row in rows:
        after: dict[int, Weight] = {}
        for state, (cost, labels) in best.items():
            for label, more, initial in row:
                then = GRAMMAR[state].get(initial) if initial else state if label == "D" else None
                if then is not None:
                    _better(after, then, (cost + more, labels + label))
        best = _with_inserts(after)
        if len(next(iter(best.values()))[1]) > 64:
            common = os.path.commonprefix([labels for _, labels in best.values()])
            if common:
                shared.append(common)
                best = {state: (cost, labels[len(common) :]) for state, (cost, labels) in best.items()}
    before = "".join(shared)
    return {state: (cost, before + labels) for state, (cost, labels) in best.items()}


def composed(before: dict[int, Weight], tables: dict[int, dict[int, Weight]]) -> dict[int, tuple[Weight, int]]:
    """What ``before`` becomes over one more stretch, each with the state in which the stretch is begun."""
    out: dict[int, tuple[Weight, int]] = {}
    for state, (cost, labels) in before.items():
        for then, (more, further) in tables[state].items():
            weight = (cost + more, labels + further)
            if then not in out or weight < out[then][0]:
                out[then] = weight, state
    return out


class Repaired:
    """The text of a conversation as its edits leave it, hashed row by row."""

    def __init__(self) -> None:
        self.state, self.n, self.hash = 0, 0, hashlib.sha256()

    def _add(self, role: str, text: str, initial: str) -> None:
        self.state = GRAMMAR[self.state][initial]
        self.hash.update(("\n" * (self.n > 0) + f"{role}:{text}").encode())
        self.n += 1

    def apply(self, labels: str, rows: Iterable[tuple[str, str]]) -> None:
        """Follow the labels over rows (role, text); what is not deleted can only have the role that the grammar takes there."""
        left = iter(rows)
        for label in labels:
            wanted = "a" if self.state == 2 else "u"
            if label == "I":
                self._add(ROLES[wanted], "", wanted)
                continue
            role, text = next(left)
            if label == "K":
                self._add(role, text, role[0])
            elif label == "R":
                self._add(ROLES[wanted], text, wanted)


class Stretch:
    """Rows (turn, role, text, duplicate) of a conversation that follow each other: counts, and what their edits cost."""

    COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.arcs: list[Arcs] = []

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        found, initial = fault(text, duplicate), role[:1]
        if found:
            setattr(self, found, getattr(self, found) + 1)
        if self.n:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.n += 1
        self.last_initial = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.arcs.append(arcs(found, initial))

    def join(self, other: "Stretch") -> None:
        """Add the counts of the stretch that follows."""
        if not other.n:
            return
        if self.n:
            self.illegal += self.last_initial + other.first_initial not in LEGAL
            self.turns -= self.last_turn is not None and self.last_turn == other.first_turn
        else:
            self.first_initial = other.first_initial
        for name in self.COUNTS:
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.last_initial = other.last_initial
        self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if other.last_turn is None else other.last_turn

    def gaps(self) -> int:
        return 0 if self.first_turn is None else min(LONGEST, self.last_turn - self.first_turn + 1 - self.turns)


def _best(ends: dict[int, Weight]) -> Weight:
    return min(ends[state] for state in FINAL if state in ends)


# ---- tables ---------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, here``: the rows after damage; a dropped row is there without being ``here``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(blank("conv_id"), F.lit(":"), blank("turn"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") != 0).alias("here"), F.explode(times).alias("copy"))
    return out.drop("copy")


def _ranges(rows: DataFrame) -> DataFrame:
    """Rows in ranges and in order: by conversation, turn (nulls first), role and text; of texts that begin with the same 64 characters
    by checksum. The last key deals rows that are equal, however many."""
    id_ = F.monotonically_increasing_id()
    keyed = rows.withColumn("tie", F.substring("text", 1, TIE_CHARS)).withColumn("crc", F.crc32(F.col("text").cast("binary"))).withColumn("row", id_)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie", "crc", "row")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns)


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "part int, pos long, turn long, role string, text string, here boolean"


def _fields(*ddl: str) -> list[str]:
    return [x.split()[0] for x in ", ".join(ddl).split(", ")]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, ROWS_A_BATCH):
        yield _batch(list(some), schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in range(0, batch.num_rows, ROWS_A_BATCH):
            yield from zip(*(c.to_pylist() for c in batch.slice(part, ROWS_A_BATCH).columns), strict=True)


def _whole(rows: list[tuple]) -> tuple:
    """The result's fields from all rows (conv_id, turn, role, text, here) of a conversation."""
    stretch, seen = Stretch(), set()
    there = [(turn, role, text) for _, turn, role, text, here in rows if here]
    for turn, role, text in there:
        stretch.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    cost, audit = _best(shortest(stretch.arcs))
    repaired = Repaired()
    repaired.apply(audit, [(role, text) for _, role, text in there])
    return (stretch.gaps(), stretch.blank, stretch.duplicate, stretch.truncated, stretch.illegal, cost, audit, repaired.hash.hexdigest())


def _within_ranges(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations inside of a range; those at its ends row by row, with the range's number and their place."""
    names = ["conv_id", *_fields(_RESULT, _ROW)]
    schema = _schema(kind, _RESULT, _ROW)
    empty = (None,) * len(_fields(_RESULT))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        as_rows = lambda run: ((r[0], *empty, part, pos, *r[1:]) for pos, r in enumerate(run))
        runs = itertools.groupby(_rows(batches), key=lambda r: r[0])
        held: list[tuple] | None = None
        for n, (_, run) in enumerate(runs):
            if n == 0:
                yield from as_rows(run)  # never held: it may fill the range
                continue
            if held is not None:
                yield (held[0][0], *_whole(held), *(None,) * len(_fields(_ROW)))
            held = list(run)
        if held is not None:
            yield from as_rows(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(results(batches), schema)

    return rows.mapInArrow(run, f"conv_id {kind}, {_RESULT}, {_ROW}").select(*names)


def _schema(kind: str, *ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(", ".join((f"conv_id {kind}", *ddl))))


_STRETCH = (
    "part int, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_initial string, last_initial string, begun array<int>, ended array<int>, costs array<long>, labels array<string>"
)
_EDITS = "part int, totals array<long>, edits string"


def _stretches(rows: DataFrame, kind: str) -> DataFrame:
    """A row for each (conversation, range): counts, and the weights from each grammar state to each other."""
    schema = _schema(kind, _STRETCH)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, part), run in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
            stretch = Stretch()
            for _, _, _, turn, role, text, here, duplicate in run:
                if here:
                    stretch.add(turn, role, text, duplicate)
            weights = [(begun, ended, *w) for begun in STATES for ended, w in shortest(stretch.arcs, begun).items()]
            counts = [getattr(stretch, name) for name in _fields(_STRETCH)[1:11]]
            yield (conv, part, *counts, *map(list, zip(*weights, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(results(batches), schema)

    dealt = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return dealt.mapInArrow(run, f"conv_id {kind}, {_STRETCH}")


def _edits(kind: str):
    """All stretches of a conversation: the best way through, as the edits of each; the totals go with the first."""
    schema = _schema(kind, _EDITS)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total, best, ways = Stretch(), {0: (0, "")}, []
        tables = []
        for r in rows:
            stretch = Stretch()
            for name in _fields(_STRETCH)[1:11]:
                setattr(stretch, name, r[name])
            total.join(stretch)
            table_: dict[int, dict[int, Weight]] = {state: {} for state in STATES}
            for begun, ended, cost, labels in zip(r["begun"], r["ended"], r["costs"], r["labels"], strict=True):
                table_[begun][ended] = cost, labels
            tables.append(table_)
            step = composed(best, table_)
            best = {state: weight for state, (weight, _) in step.items()}
            ways.append({state: begun for state, (_, begun) in step.items()})
        cost, _ = _best(best)
        state = min((s for s in FINAL if s in best), key=lambda s: best[s])
        edits = []
        for table_, way in zip(reversed(tables), reversed(ways), strict=True):
            edits.append(table_[way[state]][state][1])
            state = way[state]
        totals = [total.gaps(), total.blank, total.duplicate, total.truncated, total.illegal, cost]
        out = [(r["conv_id"], r["part"], totals if n == 0 else None, e) for n, (r, e) in enumerate(zip(rows, reversed(edits), strict=True))]
        return pa.Table.from_batches([_batch(out, schema)])

    return run


def _replayed(rows: DataFrame, edits: DataFrame, kind: str) -> DataFrame:
    """The result's fields of conversations in several stretches: their rows are read once, in order, as their edits are followed.

    A SHA-256 goes over its bytes in order, so a conversation is hashed by one task; it holds the edits and no more than a batch of rows.
    """
    schema = _schema(kind, _RESULT)
    both = rows.filter("here").select("conv_id", "part", "pos", "role", "text", F.lit(None).cast("array<long>").alias("totals"), F.lit(None).cast("string").alias("edits"))
    told = edits.select("conv_id", "part", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "totals", "edits")
    dealt = both.unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, run in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            repaired, totals, audit = Repaired(), [], []
            for _, stretch in itertools.groupby(run, key=lambda r: r[1]):
                head = next(stretch)
                totals = totals or head[5]
                audit.append(head[6])
                repaired.apply(head[6], ((r[3], r[4]) for r in stretch))
            yield (conv, *totals[:5], totals[5], "".join(audit), repaired.hash.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(results(batches), schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, {_RESULT}")


def _seen_before(rows: DataFrame) -> DataFrame:
    """``rows`` with ``duplicate``: an earlier row of the conversation has the same role and text, told by SHA-256."""
    same: Column = F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)
    place = F.struct("part", "pos")
    keyed = rows.withColumn("same", F.when(F.col("here"), same))
    often = keyed.filter("here").groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(often, "same", "left").withColumn("duplicate", F.coalesce(place > F.col("first"), F.lit(False)))


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of rows as ``damaged`` gives them.

    Rows follow each other by turn, nulls first; those of one turn by role, then by text, and of texts that begin with the same 64 characters by
    their CRC-32. Repeated rows count as often as they occur. A role's initial is its first character; a row without one can
    only be re-roled or deleted. A conversation none of whose rows is ``here`` has zeros, no edits and the hash of nothing;
    a null ``conv_id`` is a conversation like others.

    A task holds the conversations inside of its range one at a time. Longer ones are cut by ranges; then a task holds a stretch's edits, and one
    holds the labels of all stretches of a conversation, sixteen characters a row, as the result holds one.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ranged = settle(_within_ranges(_ranges(rows), kind), "conversations")
    done = ranged.filter(F.col("part").isNull()).select("conv_id", *_fields(_RESULT))
    cut = ranged.filter(F.col("part").isNotNull()).select("conv_id", *_fields(_ROW))
    marked = settle(_seen_before(cut).select("conv_id", "part", "pos", "turn", "role", "text", "here", "duplicate"), "cut-conversations")
    edits = settle(_stretches(marked, kind).groupBy("conv_id").applyInArrow(_edits(kind), f"conv_id {kind}, {_EDITS}"), "edits")
    return done.unionByName(_replayed(marked, edits, kind))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of what ``damaged`` makes of ``conversations``. Null ids, turns, roles and texts count as one space for the damage; null
    turns stay null in the order and in the gaps. An empty table gives an empty result; other columns are ignored."""
    return repair(damaged(conversations))
