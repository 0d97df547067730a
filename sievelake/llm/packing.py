"""Best-fit packing by linear grouping.

All that a plan needs is how many pieces there are of each length, 1 to the capacity: the driver plans on that
table, whose size doesn't depend on the documents. Large lengths are sorted and put into groups of equal
cardinality, and each is rounded up to its group's largest. For these few sizes the best configurations of a
sequence are found by column generation (a linear program whose columns come from an unbounded knapsack).
Whole numbers of each configuration are opened, the actual lengths take the places of the rounded ones, and
what is left over and the small pieces go by best fit, largest first, into the room that remains. A plan is a
list of runs: "of length L, ranks a to b go to the sequences from s on, at offset o". Tasks look up their
pieces' ranks in it. Several group counts and limits of "large" are planned and the fewest sequences win.

A piece's rank among those of its length is the number of such pieces in earlier tasks plus its number in its
own, so no length is ever gathered in one place.

Results for the special cases: a null or empty text is the end id alone; rows equal in id are packed each for
itself; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import bounded_batches, checkpointed, slices, texts
from sievelake.llm.encoding import encoder

#: (pieces longer than this part of the capacity are large, groups)
SETTINGS = ((1 / 4, 24), (1 / 3, 48), (1 / 2, 64))


# --- the plan ---------------------------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of sizes that is worth most within the capacity (each size any number of times)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.flatnonzero(sizes <= room)
        value[room] = value[room - 1]
        if len(fit):
            options = value[room - sizes[fit]] + worth[fit]
            k = int(np.argmax(options))
            if options[k] > value[room] + 1e-12:
                value[room], choice[room] = options[k], fit[k]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, so that the demand is met with the fewest sequences (fractions allowed)."""
    n = len(sizes)
    patterns = [np.eye(n, dtype=np.int64)[i] * (capacity // int(sizes[i])) for i in range(n)]
    inverse = np.diag([1.0 / p.sum() for p in patterns])
    amount = inverse @ demand
    for _ in range(rounds):
        worth = np.maximum(inverse.sum(axis=0), 0.0)
        value, pattern = best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-9:
            break
        change = inverse @ pattern
        steps = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(np.argmin(steps))
        if not np.isfinite(steps[leaves]):
            break
        pivot = inverse[leaves] / change[leaves]
        inverse = inverse - np.outer(change, pivot)
        inverse[leaves] = pivot
        amount = np.maximum(amount - change * steps[leaves], 0.0)
        amount[leaves] = steps[leaves]
        patterns[leaves] = pattern
    return list(zip(patterns, amount, strict=True))


class Plan:
    """Runs of pieces and the sequences opened so far, as runs of sequences with equal room."""

    def __init__(self, counts: np.ndarray) -> None:
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.rank = np.zeros(len(counts), np.int64)
        self.opened = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

    def open(self, n: int) -> int:
        self.opened += n
        return self.opened - n

    def put(self, length: int, first: int, n: int, offset: int) -> None:
        self.runs.append((length, int(self.rank[length]), n, first, offset))
        self.rank[length] += n
        self.left[length] -= n

    def leave(self, first: int, n: int, room: int) -> None:
        if n and room:
            self.room.setdefault(room, []).append((first, n))

    def place(self, patterns: list[tuple[np.ndarray, float]], groups: list[list[int]]) -> None:
        """Open whole numbers of each configuration with actual lengths, each group's largest first."""
        for pattern, amount in patterns:
            remain = int(amount + 1e-6)
            slots = [g for g in range(len(groups)) for _ in range(int(pattern[g]))]
            while remain:
                take: list[int] = []
                at = [0] * len(groups)
                for g in slots:  # the lengths of one sequence
                    queue = groups[g]
                    while at[g] < len(queue) and take.count(queue[at[g]]) >= self.here[g, queue[at[g]]]:
                        at[g] += 1
                    if at[g] < len(queue):
                        take.append(queue[at[g]])
                        self.slot_groups.append(g)
                used, self.slot_groups = self.slot_groups, []
                if not take:
                    break
                need: dict[tuple[int, int], int] = {}
                for g, length in zip(used, take, strict=True):
                    need[g, length] = need.get((g, length), 0) + 1
                n = min(remain, min(int(self.here[k]) // v for k, v in need.items()))
                first, offset = self.open(n), 0
                for g, length in zip(used, take, strict=True):
                    self.put(length, first, n, offset)
                    self.here[g, length] -= n
                    offset += length
                self.leave(first, n, self.capacity - offset)
                remain -= n

    def group(self, limit: int, n_groups: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Equal-cardinality groups of the lengths over limit: rounded sizes, how many, and their lengths (largest first)."""
        self.here: dict[tuple[int, int], int] = {}
        self.slot_groups: list[int] = []
        lengths = [x for x in range(self.capacity - 1, limit, -1) if self.left[x]]
        total = int(sum(self.left[x] for x in lengths))
        sizes: list[int] = []
        demand: list[int] = []
        groups: list[list[int]] = []
        seen = 0
        for x in lengths:
            n = int(self.left[x])
            while n:
                if not groups or seen >= len(groups) * total / n_groups:
                    sizes.append(x)
                    demand.append(0)
                    groups.append([])
                upto = -(-len(groups) * total // n_groups)
                part = max(1, min(n, upto - seen))
                g = len(groups) - 1
                groups[g].append(x)
                self.here[g, x] = part
                demand[g] += part
                seen += part
                n -= part
        return np.array(sizes), np.array(demand, float), groups

    def fill(self) -> None:
        """Best fit, largest first, of all pieces that have no place yet."""
        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                room = min((r for r in self.room if r >= length), default=None)
                if room is None:
                    need = -(-n // (self.capacity // length))
                    self.leave(self.open(need), need, self.capacity)
                    continue
                first, k = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                each = min(room // length, n)
                full = min(k, n // each)
                for j in range(each):
                    self.put(length, first, full, self.capacity - room + j * length)
                self.leave(first, full, room - each * length)
                self.leave(first + full, k - full, room)


def plan_packing(counts: np.ndarray) -> Plan:
    """counts[L]: pieces of length L, up to the capacity len(counts) - 1."""
    capacity = len(counts) - 1
    best: Plan | None = None
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    for part, n_groups in SETTINGS:
        plan = Plan(counts)
        full = int(plan.left[capacity])
        if full:
            plan.put(capacity, plan.open(full), full, 0)
        sizes, demand, groups = plan.group(int(capacity * part), n_groups)
        if len(sizes):
            plan.place(configurations(sizes, demand, capacity), groups)
        plan.fill()
        if best is None or plan.opened < best.opened:
            best = plan
        if best.opened <= least:
            break
    assert best is not None
    return best


# --- on tables --------------------------------------------------------------------------------------


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, slot = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches, "text", 2 << 20, keeps=True):
            ids, at = enc.rows(b.column("text"))
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(b.num_rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = sizes - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            order = np.argsort(length, kind="stable")
            runs = np.bincount(length, minlength=capacity + 1)
            number = np.empty(len(row), np.int64)
            number[order] = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            number += seen[length]
            seen += runs
            begin = at[row] + start
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(row), slot)), pa.array(number)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot", "number"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    bounded_batches(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long, number long" + ", ids array<int>" * with_ids
    pieces = checkpointed(texts(docs).mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), kind))
    here = pieces.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in here.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    plan = plan_packing(counts)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shift = max(1, int(counts.max())) + 1
    keys = runs[:, 0] * shift + runs[:, 1]
    earlier = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = here.select(F.col("length").alias("of_length"), F.col("slot").alias("of_slot"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, (pieces["length"] == bases["of_length"]) & (pieces["slot"] == bases["of_slot"]))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank = np.asarray(b.column("rank"))
            at = np.searchsorted(keys, np.asarray(b.column("length")) * shift + rank, side="right") - 1
            found = [b.column(c) for c in columns] + [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            names = [*columns, "sequence_id", "offset"]
            if with_ids:
                found.append(b.column("ids"))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(found, names)

    told = ranked.select(*columns, (F.col("base") + F.col("number")).alias("rank"), *(["ids"] if with_ids else []))
    return told.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves from rows with ids: sequence_id and its ids in order (at most the capacity)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
