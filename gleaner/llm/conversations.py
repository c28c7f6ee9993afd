"""Repair of conversations to an optional system turn and pairs of user and assistant turns.

A repair is a path through a graph without cycles: its nodes are (rows read, rows inserted,
state of the wanted pattern), its edges the edits.  An edge weighs one integer: the high digits
are its cost, the low ones hold a digit of three bits for every place of the audit, and the edge
puts its letter's digit at its own place.  Sums of such weights compare as (cost, audit) with
the audit padded by zeros at its end, so the plain minimum of integers settles cost and ties.

An insertion that costs more than two deletions is in no cheapest repair: without it and the
undeleted row before it (or, at the start, after it) the rows alternate as before, and at most a
lone system row has to go as well.  Then all paths to a node are equally long, and a conversation is
worked through in blocks of rows: at a block's end each state's audit so far shrinks to its
rank among the few states, and the block's letters, read off the integer's digits, are put aside.
Integers stay short, and work is linear in the rows, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import small_batches

BLOCK = 64  # rows whose letters share an integer
LETTERS = "DIKR"  # their digits count from 1 in the order of the letters' codes; 0 is no letter
BLANK, DUPLICATE, TRUNCATED, LOST = 1, 2, 3, 4
START, SYSTEM, USER, ASSISTANT = range(4)  # what was read last; also how the initials s, u and a are numbered
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class Costs(NamedTuple):
    """What edits cost; an undeleted truncated row adds `truncated`."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Repair:
    """The cheapest edits of one conversation, its rows added in order as (fault, initial)."""

    def __init__(self, costs: Costs):
        self.costs, self.rows = costs, []
        self.inserting = costs.insert <= 2 * costs.delete
        self.live = [(START, 0)]  # states and costs, in the order of their audits
        self.blocks: list[dict[int, tuple[int, str]]] = []

    def add(self, fault: int, initial: int) -> None:
        self.rows.append((fault, initial))
        if len(self.rows) == BLOCK and not self.inserting:
            self._close(0)

    def finish(self) -> tuple[int, str]:
        """Cost and audit."""
        layers = 0
        if self.inserting:
            layers = self._most_insertions()
        ends = self._close(layers)
        cost, state = min((ends[q], q) for q in (START, ASSISTANT) if q in ends)
        parts = []
        for block in reversed(self.blocks):
            state, letters = block[state]
            parts.append(letters)
        return cost >> self.width, "".join(reversed(parts))

    def _most_insertions(self) -> int:
        """How many the difference between a repair without any and the least that the rows cost pays for."""
        c, least = self.costs, 0
        plain = Repair(c._replace(insert=2 * c.delete + 1))
        for fault, initial in self.rows:
            plain.add(fault, initial)
            least += c.delete if fault in (BLANK, DUPLICATE) else min(c.delete, c.truncated) if fault else 0
        return (plain.finish()[0] - least) // c.insert

    def _close(self, layers: int) -> dict[int, int]:
        """Work through the rows gathered; gives the weights by state, if there are rows or not."""
        rows, c = self.rows, self.costs
        places = len(rows) + layers
        rank = 3 * places
        self.width = rank + 3
        unit = 1 << self.width
        never = unit << 64
        grid = [[never] * 4 for _ in range(layers + 1)]
        for k, (state, cost) in enumerate(self.live):
            grid[0][state] = cost * unit + (k << rank)

        def insert(i: int) -> None:
            for k in range(layers):
                w = c.insert * unit + (2 << rank - 3 * (i + k + 1))
                here, there = grid[k], grid[k + 1]
                there[USER] = min(there[USER], min(here[START], here[SYSTEM], here[ASSISTANT]) + w)
                there[ASSISTANT] = min(there[ASSISTANT], here[USER] + w)

        for i, (fault, initial) in enumerate(rows):
            insert(i)
            for k, here in enumerate(grid):
                place = rank - 3 * (i + k + 1)
                delete = c.delete * unit + (1 << place)
                after = [w + delete for w in here]
                if fault not in (BLANK, DUPLICATE):
                    extra = c.truncated * unit if fault else 0
                    keep, rerole = extra + (3 << place), extra + c.rerole * unit + (4 << place)
                    if initial == SYSTEM:
                        after[SYSTEM] = min(after[SYSTEM], here[START] + keep)
                    after[USER] = min(after[USER], min(here[START], here[SYSTEM], here[ASSISTANT]) + (
                        keep if initial == USER else rerole))
                    after[ASSISTANT] = min(after[ASSISTANT], here[USER] + (keep if initial == ASSISTANT else rerole))
                grid[k] = after
        insert(len(rows))
        ends = {q: w for q in range(4) if (w := min(layer[q] for layer in grid)) < never}
        # A state is told by the letters that lead to it, so no two audits are equal here.
        order = sorted(ends, key=lambda q: ends[q] & (unit - 1))
        self.blocks.append({q: (self.live[ends[q] >> rank & 7][0], _letters(ends[q], places)) for q in order})
        self.live, self.rows = [(q, ends[q] >> self.width) for q in order], []
        return ends


def _letters(weight: int, places: int) -> str:
    digits = (weight >> 3 * (places - 1 - p) & 7 for p in range(places))
    return "".join(LETTERS[d - 1] for d in digits if d)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) damaged by crc32(`conv_id:turn`) modulo 20.

    0 loses the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes
    its role user.  A null is one space, but for conv_id and turn as columns.  A lost row stays, marked,
    so that its conversation is known.
    """
    def word(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


STATS = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _plan(costs: Costs):
    class Conversation:
        def __init__(self) -> None:
            self.repair = Repair(costs)
            self.faults = [0] * 4
            self.n = self.illegal = self.turns = 0
            self.low = self.high = self.last = None

        def add(self, turn: int | None, fault: int, initial: int) -> None:
            if self.n and (self.last, initial) not in LEGAL:
                self.illegal += 1
            self.n, self.last = self.n + 1, initial
            self.faults[fault] += 1
            if turn is not None:
                if self.low is None:
                    self.low = turn
                self.turns += turn != self.high
                self.high = turn
            self.repair.add(fault, initial)

        def row(self) -> tuple:
            cost, audit = self.repair.finish()
            gaps = min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
            return (self.n, gaps, *self.faults[1:], self.illegal, cost, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, begun = Conversation(), None, False
        for batch in batches:
            names, done = [], []
            for conv, turn, fault, initial in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if begun and conv != name:
                    names.append(name)
                    done.append(now.row())
                    now = Conversation()
                name, begun = conv, True
                if fault != LOST:
                    now.add(turn, fault, initial)
            yield packed(names, done, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if begun:
            yield packed([name], [now.row()], kind)

    def packed(names: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * (len(STATS) + 1)
        types = [pa.int64()] * len(STATS) + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, kind), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            names=["conv_id", *STATS, "audit"])
    return run


def _rows(rows: DataFrame) -> DataFrame:
    lost = F.coalesce("lost", F.lit(False)) if "lost" in rows.columns else F.lit(False)
    blank = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
                       F.coalesce("text", blank).alias("text"), lost.alias("lost"))


def find_repairs(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A conversation is the rows of a conv_id by turn, nulls first, those of one turn by role and
    text.  blank, duplicate and truncated count rows by their first fault: no word; role and text
    seen earlier; the last byte that isn't white space not one of `.!?`.  gaps counts the missing turns, illegal
    the neighbours whose roles' initials aren't su, ua or au.  The audit is the letters of the
    cheapest edits, K(eep), R(erole), D(elete), I(nsert), the ASCII-least of equally cheap ones, that
    give the initials (s?(ua)+)?; blank and duplicate rows are deleted.

    A null role or text is one space; a null conv_id is a conversation like any other; equal rows
    are rows of their own, of which all but the first are duplicates.  An empty role has no
    initial, so it can't be kept.  A row whose column `lost`, if there is one, holds is no row but keeps its
    conversation in the result: one without rows has zeros and an empty audit.  An empty table
    gives an empty result.  Gaps beyond a long are given as the largest.  Other columns are left out.

    The rows are dealt out by conversation once and streamed in order: a task holds the letters of
    the conversation at hand, never its texts.
    """
    dealt = _rows(rows).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    ending = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(F.col("lost"), LOST).when(F.col("ending") == "", BLANK).when(F.col("nth") > 1, DUPLICATE)
             .when(~F.col("ending").isin(".", "!", "?"), TRUNCATED).otherwise(0).cast("byte"))
    initial = F.substring("role", 1, 1)
    state = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0).cast("byte")
    told = dealt.withColumn("nth", nth).withColumn("ending", ending)
    ordered = told.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    return ordered.select("conv_id", "turn", fault.alias("fault"), state.alias("initial")).mapInArrow(
        _plan(costs), f"conv_id {kind}, {', '.join(f'{s} long' for s in STATS)}, audit string")


class Edited(NamedTuple):
    """A row of a repaired conversation."""

    conv: object
    place: int
    edit: str
    turn: int | None
    role: str
    text: str


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[Edited]]]:
    """Heads and edited rows, in order: a head is the repair of the conversation whose rows follow it."""
    head, at, place = {}, 0, 0

    def inserted() -> Iterator[Edited]:
        nonlocal at, place
        while at < len(head["audit"]) and head["audit"][at] == "I":
            yield Edited(head["conv_id"], place, "I", None, turn_role(), "")
            at, place = at + 1, place + 1

    def turn_role() -> str:
        return "user" if (place - system) % 2 == 0 else "assistant"

    system = 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                head, at, place, system = row, 0, 0, 0
                yield head, list(inserted())
                continue
            edit = head["audit"][at]
            at += 1
            out = []
            if edit != "D":
                if edit == "K" and place == 0 and row["role"].startswith("s"):
                    system = 1
                role = row["role"] if edit == "K" else turn_role()
                out.append(Edited(head["conv_id"], place, edit, row["turn"], role, row["text"]))
                place += 1
            out += inserted()
            yield None, out


def _repaired(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def packed(rows: list[Edited]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=["conv_id", "place", "edit", "turn", "role", "text"])

    held: list[Edited] = []
    for _, rows in _edited(batches):
        held += rows
        if len(held) >= 1000:
            yield packed(held)
            held = []
    yield packed(held)


def _digests(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [kind, *[pa.int64()] * len(STATS), pa.string(), pa.string()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=["conv_id", *STATS, "audit", "repaired_sha256"])

    head, digest, lines, done = None, None, 0, []

    def close() -> None:
        if head is not None:
            done.append((head["conv_id"], *[head[s] for s in STATS], head["audit"], digest.hexdigest()))

    for new, rows in _edited(batches):
        if new is not None:
            close()
            head, digest, lines = new, hashlib.sha256(), 0
            if len(done) >= 1000:
                yield packed(done)
                done = []
        for row in rows:
            digest.update(f"{'' if lines == 0 else '\n'}{row.role}:{row.text}".encode())
            lines += 1
    close()
    yield packed(done)


def _with_heads(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The rows behind their conversation's repair, dealt out by conversation and in order."""
    small_batches(rows.sparkSession)
    columns = ["conv_id", "turn", "role", "text", *STATS, "audit"]
    there = _rows(rows).filter("not lost").select("conv_id", "turn", "role", "text", *[
        F.lit(None).cast("long").alias(s) for s in STATS], F.lit(None).cast("string").alias("audit"))
    heads = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"), *STATS, "audit")
    return heads.union(there.select(columns)).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), turn, role, text.

    rows and repairs are those that find_repairs took and gave.  An inserted row has no turn and an
    empty text.
    """
    kind = repairs.select("conv_id").schema[0].dataType.simpleString()
    arrow = repairs.select("conv_id").limit(0).toArrow().schema.field(0).type
    return _with_heads(rows, repairs).mapInArrow(
        lambda b: _repaired(b, arrow), f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def repair_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """repairs with repaired_sha256: of the repaired rows as `role:text`, joined by newlines.

    The hash runs along with the rows that repaired_rows gives, so a conversation is never held whole.
    """
    kind = repairs.select("conv_id").schema[0].dataType.simpleString()
    arrow = repairs.select("conv_id").limit(0).toArrow().schema.field(0).type
    fields = f"conv_id {kind}, {', '.join(f'{s} long' for s in STATS)}, audit string, repaired_sha256 string"
    return _with_heads(rows, repairs).mapInArrow(lambda b: _digests(b, arrow), fields)
