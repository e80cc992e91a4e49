"""Conversation structure repair: the cheapest edits that give a conversation its form, as a retained-subsequence DP.

The form of role initials is ``(s?(ua)+)?``. Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an
empty turn (2); a truncated row that stays adds 1. A choice of retained rows with their roles fixes all else: between two
retained rows everything is deleted, and the pair of their roles says which turns are inserted. So with prefix sums P of
deletion costs and S_r(j+1) the cost of what follows a row j that stays as role r,

    g_r(j) = P(j) + own cost + S_r(j + 1),   M_r = least g_r(j) over the rows from i on,
    S_q(i) = min(P(n) + end_q, min over r of (2 inserts(q, r) + M_r)) - P(i):

one step a row, from the last to the first, with a running minimum for each role. Of equal costs the audit that is least in
ASCII is taken, D before I before K before R. As equal audits differ first where one deletes more rows, then where one
inserts more, a walk from the first row that prefers D, then more I, then K finds it from the costs alone.

On Spark: rows after damage are counted by (conv_id, turn, role, text), so copies are one row; rows whose text stood in an
earlier turn are found by one aggregate and a join. Rows are then range-sorted by (conv_id, turn, role, digest), so one
conversation may span many tasks. Conversations inside one task are repaired there. Of those at a task's edges each
task's part is a block: its 4 x 4 matrix of least costs from state to state is computed for each block on its own, the few
matrices of a conversation are combined from the last to the first, and its rows pass once in order with one block in
memory, for the digest of a conversation is one SHA-256 over all of it and knows no other way.

Defined results: a null role or text is one space, a null id or turn counts as one space for the damage; a null conv_id is a
conversation of its own; turns of a conversation that are equal stand by role, then by SHA-256 of the text; an empty role or one with another
initial is no user, assistant or system and cannot be kept. A conversation without rows after damage has zeros, an empty
audit and the digest of the empty string. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import WORD, Kept, small_batches

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: nothing retained yet, or the role retained last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Inserts between what stands (row) and the role that comes next (column: system, user, assistant), and at the end.
BETWEEN = ((0, 0, 1), (None, 0, 1), (None, 1, 0), (None, 0, 1))
AT_END = (0, 2, 1, 0)
END = [k * INSERT for k in AT_END]
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
ENDS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage that crc32(conv_id:turn) % 20 names; nulls in role and text are spaces."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows of equal turn, role and text as one, with the fault of the first of them."""
    keys = ["conv_id", "role", "digest"]
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    blank: Column = ~F.col("text").rlike(WORD)
    seen = rows.filter(~blank).withColumn("digest", F.sha2("text", 256)).groupBy(*keys).agg(F.min(turn).alias("first"), F.max(turn).alias("last"))
    seen = Kept(seen.filter("first < last").select(*(F.col(k).alias(f"_{k}") for k in keys), "first"), "turns-seen", counted=True)
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    ends = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(blank, BLANK).when(F.col("first") < turn, DUPLICATE).when(~ends.isin(*ENDS), CUT).otherwise(SOUND)
    return runs.join(seen.side(), same, "left").select("conv_id", "turn", "role", "digest", "text", "copies", fault.alias("fault"))


@dataclass
class Row:
    turn: int | None
    role: str
    text: str
    copies: int
    fault: int


def prices(rows: list[Row], end: list[int]) -> list[tuple[int, ...]]:
    """For each row and past the last: the least cost of what follows, in each state. end: the costs past the last row."""
    before = [0]
    for row in rows:
        before.append(before[-1] + DELETE * row.copies)
    least, out = [NEVER] * 3, [tuple(end)]
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        if row.fault not in (BLANK, DUPLICATE):
            own = STATE.get(row.role[:1])
            stays = before[i] + DELETE * (row.copies - 1) + TRUNCATED * (row.fault == CUT)
            for r in (SYSTEM, USER, ASSISTANT):
                if r == own or r != SYSTEM:
                    least[r - 1] = min(least[r - 1], stays + REROLE * (r != own) + out[-1][r])
        out.append(tuple(min(min(before[-1] + end[q], *(INSERT * k + m for k, m in zip(BETWEEN[q], least, strict=True) if k is not None)) - before[i], NEVER) for q in range(4)))
    return out[::-1]


def edits(rows: list[Row], cost: list[tuple[int, ...]], q: int) -> tuple[list[tuple[str, int]], int]:
    """The least audit of least cost from state q on: for each row its letters and the state after it; and the last state."""
    out = []
    for i, row in enumerate(rows):
        here, after, letters = cost[i][q], cost[i + 1], ""
        if DELETE * row.copies + after[q] == here:
            letters = "D" * row.copies
        else:
            own, stays = STATE.get(row.role[:1]), DELETE * (row.copies - 1) + TRUNCATED * (row.fault == CUT)
            ways = [(-k, r != own, r) for r, k in enumerate(BETWEEN[q], 1) if k is not None and (r == own or r != SYSTEM) and INSERT * k + REROLE * (r != own) + stays + after[r] == here]
            k, changed, r = min(ways)
            letters, q = "I" * -k + "KR"[changed] + "D" * (row.copies - 1), r
        out.append((letters, q))
    return out, q


@dataclass
class Repair:
    """One conversation, block after block in order: its counts, its audit and the digest of what is left of it."""

    state: int = START
    last: str | None = None
    turn: int | None = None
    low: int | None = None
    turns: int = 0
    cost: int | None = None
    audit: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    begun: bool = False

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun = True

    def insert(self, k: int) -> None:
        for _ in range(k):
            self.state = USER if self.state in (START, SYSTEM, ASSISTANT) else ASSISTANT
            self.put(ROLES[self.state], "")

    def feed(self, rows: list[Row], end: list[int]) -> None:
        for row in rows:
            if row.turn is not None and row.turn != self.turn:
                self.low, self.turn, self.turns = row.turn if self.low is None else self.low, row.turn, self.turns + 1
            self.counts[row.fault] += 1
            self.counts[BLANK if row.fault == BLANK else DUPLICATE] += row.copies - 1
            own = row.role[:1]
            self.illegal += self.last is not None and self.last + own not in LEGAL
            self.illegal += (row.copies - 1) * (own + own not in LEGAL)
            self.last = own
        cost = prices(rows, end)
        if self.cost is None:
            self.cost = cost[0][START]
        for row, (letters, q) in zip(rows, edits(rows, cost, self.state)[0], strict=True):
            self.audit.append(letters)
            self.insert(letters.count("I"))
            if "K" in letters or "R" in letters:
                self.put(row.role if "K" in letters else ROLES[q], row.text)
            self.state = q

    def result(self) -> tuple:
        self.audit.append("I" * AT_END[self.state])
        self.insert(AT_END[self.state])
        gaps = 0 if self.turn is None else self.turn - self.low + 1 - self.turns
        return gaps, *self.counts[1:], self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "turn long, role string, text string, copies long, fault int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


_SPLIT = f"conv_id long, inside boolean, {RESULT}, {_ROW}"


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id and _ROW) of a task: results of the conversations between its first and its last, the rows of these two."""
    first = own = None
    held: list[Row] = []
    out: list[tuple] = []
    size = 0

    def rows_out(conv: int | None, rows: list[Row]) -> None:
        out.extend((conv, False, *[None] * 8, r.turn, r.role, r.text, r.copies, r.fault) for r in rows)

    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first is None:
                first = own = (conv,)
            elif own != (conv,):
                if own == first:
                    rows_out(own[0], held)
                else:
                    repair = Repair()
                    repair.feed(held, END)
                    out.append((own[0], True, *repair.result(), *[None] * 5))
                own, held = (conv,), []
            held.append(Row(*row))
            if own == first:
                rows_out(conv, held)
                held = []
            size += len(row[2])
            if len(out) >= 1000 or size > 1 << 24:
                yield _batch(out, _SPLIT)
                out, size = [], 0
    if own is not None:
        rows_out(own[0], held)
    yield _batch(out, _SPLIT)


def _blocks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """From rows sorted by (conv_id, block, ...): conv_id, block, the values of the block's first row in the ``columns`` that follow, its Rows."""
    own, head, held = None, None, []
    for batch in batches:
        for conv, block, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != (conv, block):
                if own is not None:
                    yield *own, head, held
                own, head, held = (conv, block), rest[:columns], []
            held.append(Row(*rest[columns:]))
    if own is not None:
        yield *own, head, held


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, block, _, rows in _blocks(batches, 0):
        ways = [prices(rows, [0 if q == r else NEVER for q in range(4)])[0] for r in range(4)]
        out.append((conv, block, [ways[r][q] for q in range(4) for r in range(4)]))
    yield _batch(out, "conv_id long, block int, costs array<long>")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices sorted by conv_id and block from the last to the first: for each block the costs past its last row."""
    own, end, out = None, END, []
    for batch in batches:
        for conv, block, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != (conv,):
                own, end = (conv,), END
            out.append((conv, block, end))
            end = [min(min(costs[4 * q + r] + end[r] for r in range(4)), NEVER) for q in range(4)]
    yield _batch(out, "conv_id long, block int, past array<long>")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, repair, out = None, None, []
    for conv, _, (past,), rows in _blocks(batches, 1):
        if own != (conv,):
            if own is not None:
                out.append((own[0], *repair.result()))
            own, repair = (conv,), Repair()
        repair.feed(rows, past)
    if own is not None:
        out.append((own[0], *repair.result()))
    yield _batch(out, f"conv_id long, {RESULT}")


def repair(rows: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text): a row for each conv_id with RESULT. ``damaged``: what damage() returns, if not of rows."""
    kept = damaged if damaged is not None else damage(small_batches(rows))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    columns = ["conv_id", *(c.split()[0] for c in _ROW.split(", "))]
    placed = _marked(kept).repartitionByRange(*order).sortWithinPartitions(*order)
    split = placed.select(*columns).mapInArrow(_inside, _SPLIT).withColumn("block", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    split = Kept(split, "conversations").df
    edges = split.filter("not inside").select("conv_id", "block", "at", *columns[1:])
    slim = edges.withColumn("text", F.lit("")).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").drop("at")
    matrices = slim.mapInArrow(_matrices, "conv_id long, block int, costs array<long>")
    ends = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_ends, "conv_id long, block int, past array<long>")
    ends = Kept(ends.withColumnsRenamed({"conv_id": "_conv_id", "block": "_block"}), "conversation-ends", counted=True)
    joined = edges.join(ends.side(), F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("block") == F.col("_block")))
    ordered = joined.select("conv_id", "block", "at", "past", *columns[1:]).repartition("conv_id").sortWithinPartitions("conv_id", "block", "at").drop("at")
    done = ordered.mapInArrow(_whole, f"conv_id long, {RESULT}")
    names = [c.split()[0] for c in RESULT.split(", ")]
    gone = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(kept.select(F.col("conv_id").alias("_c")).distinct(), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    gone = gone.select("conv_id", *(F.lit(0).cast("long").alias(n) for n in names[:6]), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return split.filter("inside").select("conv_id", *names).unionByName(done).unionByName(gone)
