"""Conversation structure repair: weighted CYK parsing of edits over the rows of a conversation.

A conversation is in order if its roles' initials give `(s?(ua)+)?`. Rows may be kept, given another
role or deleted, and rows without text inserted, each at a price; `parse` finds the cheapest edits.

The grammar is in Chomsky normal form. A symbol stands for what a span's rows become: nothing
(E), or a word in which u and a alternate, by its first and last role and whether an s leads it.
Each binary rule joins two symbols that fit together; each row derives symbols at the price of an
edit; start symbols are E and the words that begin s?u and end in a. A cell of the chart holds for
each symbol the least (cost, audit), the audit being the edits' initials in order; it is closed
under insertions before and after the span. Cells are filled bottom-up by span length over all
splits. At equal cost no audit of a span begins another (the rest would be insertions, which
cost), so the least audits of two spans joined are the least of the whole.

Symbols are closed under joining, so a chart's top cell serves as a leaf of another chart: long
conversations are parsed LEAVES rows at a time, and the charts' tops likewise, at a cost in
proportion to the rows. Rows are dealt by ranges of (conversation, turn, ...), so the rows of a
very long conversation are parsed by many tasks, and one small row of cells for each is joined
(`parsed`). Only the hash of the repaired text has to see a conversation in order, since SHA-256
is sequential: its rows stream through one task in sorted batches, never held together.

A missing conv_id, turn, role or text counts as one space where it is written (in the hash that
damages rows, in roles and texts); rows are ordered by turn, nulls first, then by role and a hash of the text.
Repeated rows occur as often as they are given. Rows with a null conv_id are one conversation.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsift.llm.common import stored
from tarsift.session import ship_with_tasks

#: Leaves of one chart.
LEAVES = 12
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLACK = r"[^\x20\x09-\x0D]"
FAULTS = ("blank", "duplicate", "truncated")
COLUMNS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)

Cell = dict[str, tuple[int, str]]
#: Symbols: "" is E; "ua" begins with u and ends with a; "sa" begins with s and ends with a;
#: "ss" is s alone.
START = ("", "ua", "sa")


def joins(left: str, right: str) -> str | None:
    """The symbol of two joined words, None where they do not fit."""
    if not left or not right:
        return left or right
    if right[0] == "s":
        return None
    if left == "ss":
        return "s" + right[1] if right[0] == "u" else None
    return left[0] + right[1] if left[1] != right[0] else None


SYMBOLS = ["", "ss", "sa", "su", *(a + b for a in "ua" for b in "ua")]
RULES = {(x, y): z for x in SYMBOLS for y in SYMBOLS if (z := joins(x, y)) is not None}


def improve(cell: Cell, symbol: str, cost: int, audit: str) -> bool:
    have = cell.get(symbol)
    if have is None or (cost, audit) < have:
        cell[symbol] = (cost, audit)
        return True
    return False


def closed(cell: Cell) -> Cell:
    """The cell with every insertion before and after its span that makes some symbol cheaper."""
    grown = True
    while grown:
        grown = False
        for symbol, (cost, audit) in list(cell.items()):
            for new in ("uu", "aa"):
                if (after := RULES.get((symbol, new))) is not None:
                    grown |= improve(cell, after, cost + INSERT, audit + "I")
                if (before := RULES.get((new, symbol))) is not None:
                    grown |= improve(cell, before, cost + INSERT, "I" + audit)
    return cell


def leaf(initial: str, fault: int) -> Cell:
    """What one row derives; fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    cell: Cell = {"": (DELETE, "D")}
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        for role in "ua":
            improve(cell, role + role, REROLE + more, "R")
        if initial in ("u", "a", "s"):
            improve(cell, initial + initial, more, "K")
    return closed(cell)


_LEAF = {(initial, fault): leaf(initial, fault) for initial in "uas?" for fault in range(4)}


def joined(left: Cell, right: Cell, into: Cell) -> None:
    for x, (cost, audit) in left.items():
        for y, (more, rest) in right.items():
            z = RULES.get((x, y))
            if z is not None:
                total = cost + more
                have = into.get(z)
                if have is None or total < have[0] or (total == have[0] and audit + rest < have[1]):
                    into[z] = (total, audit + rest)


def chart(cells: list[Cell]) -> Cell:
    """The cell over all of them: spans bottom-up by length, all splits of each."""
    n = len(cells)
    spans: dict[tuple[int, int], Cell] = {(k, k + 1): cell for k, cell in enumerate(cells)}
    for length in range(2, n + 1):
        for start in range(n - length + 1):
            cell: Cell = {}
            for split in range(start + 1, start + length):
                joined(spans[start, split], spans[split, start + length], cell)
            spans[start, start + length] = closed(cell)
    return spans[0, n]


class Tower:
    """Charts over cells that arrive one after another, LEAVES at a time on each level."""

    def __init__(self) -> None:
        self.levels: list[list[Cell]] = [[]]

    def add(self, cell: Cell, level: int = 0) -> None:
        while level < len(self.levels):
            self.levels[level].append(cell)
            if len(self.levels[level]) < LEAVES:
                return
            cell = chart(self.levels[level])
            self.levels[level] = []
            level += 1
        self.levels.append([cell])

    def top(self) -> Cell:
        row: list[Cell] = []
        for level in self.levels:
            row = level + row
            while len(row) > LEAVES:
                row = [chart(row[:LEAVES]), *row[LEAVES:]]
        return chart(row) if row else {"": (0, "")}


def parse(cell: Cell) -> tuple[int, str]:
    """The least cost and audit of a whole conversation."""
    return min(cell[symbol] for symbol in START if symbol in cell)


def parse_rows(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """As `parse`, of rows given as (initial, fault)."""
    tower = Tower()
    for initial, fault in rows:
        tower.add(_LEAF[initial if initial in ("u", "a", "s") else "?", fault])
    return parse(tower.top())


def written(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the hash of `conv_id:turn` deals out."""
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        written("role").alias("role"),
        written("text").alias("text"),
        kind.alias("kind"),
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        *("conv_id", "turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows with `place`, by which they are ordered within a turn, and `fault` (0 to 3).

    A duplicate is not the first of its conversation's rows with one role and text."""
    same = [F.xxhash64(F.lit(seed), "role", "text") for seed in (1, 2)]
    earlier = Window.partitionBy("conv_id", *same).orderBy(F.col("turn").asc_nulls_first(), "copy")
    rows = rows.withColumn("nth", F.row_number().over(earlier))
    return rows.select(
        *("conv_id", "turn", "role", "text"),
        F.col("nth").alias("place"),
        F.when(~F.col("text").rlike(BLACK), 1)
        .when(F.col("nth") > 1, 2)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3)
        .otherwise(0)
        .alias("fault"),
    )


def in_order(*first: str) -> list[Column]:
    """The order of rows: conversations, then `first`, then turns with ties by role and text."""
    conv, turn = F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()
    return [conv, *map(F.col, first), turn, F.col("role"), F.col("mark"), F.col("place")]


def parsed(rows: DataFrame) -> DataFrame:
    """conv_id, illegal, cost and audit of each conversation that has rows.

    Only initials and faults are dealt out, by ranges; a range's piece of a conversation leaves as
    one row: its cells, its ends and where it stands."""
    light = rows.select(
        *("conv_id", "turn", "role", "place", "mark"),
        F.substring("role", 1, 1).alias("initial"),
        "fault",
    )
    by = in_order()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        state: list = []
        out: list[tuple] = []

        def done() -> None:
            conv, tower, first, last, illegal = state
            out.append((conv, at, first, last, illegal, pickle.dumps(tower.top())))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["conv_id", "at", "first", "last", "illegal", "cells"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            for conv, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state or state[0] != conv:
                    if state:
                        done()
                    state = [conv, Tower(), initial, None, 0]
                if state[3] is not None and state[3] + initial not in ("su", "ua", "au"):
                    state[4] += 1
                state[1].add(_LEAF[initial if initial in ("u", "a", "s") else "?", fault])
                state[3] = initial
            if len(out) >= 4096:
                yield batch_of()
                out.clear()
        if state:
            done()
        yield batch_of()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for conv, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tower = Tower()
                for part in parts:
                    tower.add(pickle.loads(part["cells"]))
                illegal = sum(part["illegal"] for part in parts)
                illegal += sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in pairwise(parts))
                found.append((conv, illegal, *parse(tower.top())))
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "illegal", "cost", "audit"]
            )

    dealt = light.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "initial", "fault")
    cells = dealt.mapInArrow(
        pieces, "conv_id long, at int, first string, last string, illegal long, cells binary"
    )
    # A conversation has one piece for each range that it reaches into.
    gathered = cells.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "first", "last", "illegal", "cells"))).alias("parts")
    )
    return gathered.mapInArrow(whole, "conv_id long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and the hash of the repaired conversation, its rows streamed in order after its audit."""
    nothing = F.lit(None).cast("string")
    stream = audits.select(
        "conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"),
        F.lit(None).cast("long").alias("mark"), F.lit(0).alias("place"), F.col("audit").alias("text"),
    ).union(rows.select("conv_id", F.lit(1).alias("step"), "turn", "role", "mark", "place", "text"))
    by = in_order("step")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        convs: list = []
        hashes: list[str] = []
        for batch in batches:
            for conv, step, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step == 0:
                    if state:
                        finished(state, convs, hashes)
                    state = [conv, text, 0, "", hashlib.sha256()]
                else:
                    edit(state, role, text)
            if len(convs) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(hashes)], ["conv_id", "sha"])
                convs, hashes = [], []
        if state:
            finished(state, convs, hashes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(convs, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "sha"]
        )

    dealt = stream.repartition("conv_id").sortWithinPartitions(*by).select("conv_id", "step", "role", "text")
    return dealt.mapInArrow(scan, "conv_id long, sha string")


def follow(state: list) -> str:
    """The role that stands next: u at the start and after s and a, a after u."""
    return "assistant" if state[3] == "u" else "user"


def put(state: list, role: str, text: str) -> None:
    state[4].update(("\n" if state[3] else "").encode() + f"{role}:{text}".encode())
    state[3] = role[:1]


def inserted(state: list) -> None:
    while state[2] < len(state[1]) and state[1][state[2]] == "I":
        put(state, follow(state), "")
        state[2] += 1


def edit(state: list, role: str, text: str) -> None:
    """One row by the audit's next letter; state: conv, audit, position, last initial, hash."""
    inserted(state)
    letter = state[1][state[2]]
    state[2] += 1
    if letter == "K":
        put(state, role, text)
    elif letter == "R":
        put(state, follow(state), text)


def finished(state: list, convs: list, hashes: list[str]) -> None:
    inserted(state)
    convs.append(state[0])
    hashes.append(state[4].hexdigest())


def repair(conversations: DataFrame) -> DataFrame:
    """COLUMNS: one row for each conv_id of the given rows, about their damaged rows."""
    rows = with_faults(damaged(conversations))
    rows = stored(rows.withColumn("mark", F.xxhash64("text")))
    audits = stored(parsed(rows))
    turns = (
        rows.groupBy("conv_id", "turn")
        .agg(*(F.sum((F.col("fault") == k + 1).cast("long")).alias(name) for k, name in enumerate(FAULTS)))
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
            *(F.sum(name).alias(name) for name in FAULTS),
        )
    )
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (turns, audits, repaired(rows, audits)):
        out = out.join(more.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zeros = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select(
        "conv_id",
        *zeros,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


ship_with_tasks(__name__)
