"""Exact dedup with Patricia-trie owners.

Texts are dealt by length and content hash. A task inserts the full byte strings into compressed radix tries, one
for each length and first byte of the hash, which branch by the texts' own bytes; a terminal node holds the id that
stays, the number of copies, the hash, and on demand the other columns of the row that stays. Map tasks build tries
of their own first, so a group of copies sends one row from each task, not one for each row. When tries outgrow
their memory, subtrees are spilled, largest trie first and in it by the first byte of its strings: a map task sends
their terminals on as partial rows; a reduce task, whose rows come sorted by length and hash, sends on what can't
grow any more. Inputs read by very many tasks merge in two levels (FAN_IN).

Results for the special cases: a null text is the empty text; null ids rank below all others; of rows that
are equal in id and text one is kept and the others are dropped, in keep_distinct() the one whose other columns
come first in the order of their written form; texts of any length are strings like all others, and a task holds
one that is longer than the memory set aside for tries by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.llm.common import bounded_batches, checkpointed, likely_partitions, spread_join, texts

TRIE_BYTES = 48 << 20
FAN_IN = 1024
OUT_BYTES = 4 << 20
NODE_BYTES = 200  # of a node beside its label, about

NodeT = list  # [label, children by first byte, terminal: [top, n, header, row] or None]


def agreement(key: bytes, at: int, label: bytes) -> int:
    """How many bytes of `label` the key has from `at` on: steps that double, then halves."""
    most = min(len(label), len(key) - at)
    low, step = 0, 32
    while low < most and key[at + low : at + low + step] == label[low : min(low + step, most)]:
        low, step = min(low + step, most), step * 2
    high = min(low + step, most)
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings. Each edge holds a run of bytes; nodes branch or end a string."""

    def __init__(self) -> None:
        self.root: NodeT = [b"", {}, None]
        self.held = 0
        self.below: dict[int, int] = {}  # what is held below each first byte

    def _grown(self, key: bytes, size: int) -> None:
        self.held += size
        if key:
            self.below[key[0]] = self.below.get(key[0], 0) + size

    def insert(self, key: bytes, top: int | None, n: int, header: object, smallest: bool = False, row: Any = None, row_bytes: int = 0) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                leaf: NodeT = [key[at:], {}, None]
                node[1][key[at]] = leaf
                self._grown(key, len(key) - at + NODE_BYTES)
                node = leaf
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low = agreement(key, at, label)
            fork: NodeT = [label[:low], {label[low]: child}, None]
            child[0] = label[low:]
            node[1][key[at]] = fork
            self._grown(key, NODE_BYTES)
            node, at = fork, at + low
        if node[2] is None:
            node[2] = [top, n, header, row]
            self._grown(key, row_bytes)
            return
        end = node[2]
        end[1] += n
        better = top is not None and (end[0] is None or (top < end[0] if smallest else top > end[0]))
        if better or top == end[0] and row is not None and repr(row) < repr(end[3]):
            end[0], end[3] = top, row

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Every string with its terminal, in no particular order."""
        yield from _below(self.root, b"")

    def take(self) -> Iterator[tuple[bytes, list]]:
        """Remove the subtree that holds most, of those by first byte, and give what it held."""
        if not self.below:
            end, self.root[2], self.held = self.root[2], None, 0
            if end is not None:
                yield b"", end
            return
        byte = max(self.below, key=self.below.__getitem__)
        self.held -= self.below.pop(byte)
        yield from _below(self.root[1].pop(byte), b"")


def _below(node: NodeT, path: bytes) -> Iterator[tuple[bytes, list]]:
    stack = [(node, path)]
    while stack:
        node, path = stack.pop()
        path += node[0]
        if node[2] is not None:
            yield path, node[2]
        stack.extend((child, path) for child in node[1].values())


class Owners:
    """Tries by length and first byte of the content hash, with a count of what they hold."""

    def __init__(self, smallest: bool = False) -> None:
        self.tries: dict[tuple[int, int], PatriciaTrie] = {}
        self.smallest = smallest
        self.held = 0

    def add(self, length: int, digest: bytes, text: bytes, top: int | None, n: int, row: Any = None, row_bytes: int = 0) -> None:
        trie = self.tries.get((length, digest[0]))
        if trie is None:
            trie = self.tries[length, digest[0]] = PatriciaTrie()
        before = trie.held
        trie.insert(text, top, n, digest, self.smallest, row, row_bytes)
        self.held += trie.held - before

    def take_all(self) -> Iterator[tuple]:
        """Remove everything and give it: length, digest, text, top, n, row."""
        tries, self.tries, self.held = self.tries, {}, 0
        for (length, _), trie in tries.items():
            for text, (top, n, digest, row) in trie.items():
                yield length, digest, text, top, n, row

    def spill(self) -> Iterator[tuple]:
        """Remove subtrees of the largest tries until half of the memory is free, and give what they held."""
        for key in sorted(self.tries, key=lambda k: -self.tries[k].held):
            trie = self.tries[key]
            while trie.held and self.held > TRIE_BYTES // 2:
                before = trie.held
                for text, (top, n, digest, row) in trie.take():
                    yield key[0], digest, text, top, n, row
                self.held -= before - trie.held
            if not trie.held:
                del self.tries[key]
            if self.held <= TRIE_BYTES // 2:
                return


_COLUMNS = ("length", "digest", "body", "top", "n", "slot", "row")


def _send(rows: Iterator[tuple], slot: int, names: tuple[str, ...], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        length, digest, body, top, n, row = zip(*held, strict=True)
        all_of = {"length": (length, pa.int64()), "digest": (digest, pa.binary()), "body": (body, pa.binary()), "top": (top, pa.int64()), "n": (n, pa.int64()), "slot": ([slot] * len(held), pa.int64()), "row": (row, kind)}
        return pa.RecordBatch.from_arrays([pa.array(*all_of[k]) for k in names], list(names))

    for row in rows:
        held.append(row)
        size += len(row[2]) + 100
        if size >= OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _checked(rows: Iterator[tuple]) -> Iterator[tuple]:
    seen: dict[tuple, bytes] = {}
    for row in rows:
        if seen.setdefault(row[:2], row[2]) != row[2]:
            raise RuntimeError("two texts of one length share a SHA-256 digest; owners by digest would mix them")
        yield row


def _merge(first: bool, last: bool, smallest: bool, out: tuple[str, ...]):
    """One level of tries over the batches of a task; the last one needs rows sorted by length and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() if first else 0
        owners = Owners(smallest)
        now: tuple | None = None
        kind = pa.null()
        for b in batches:
            kind = b.schema.field("row").type
            row_bytes = 3 * b.column("row").nbytes // max(b.num_rows, 1)  # as Python objects, about
            for length, digest, body, top, n, s, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not first:
                    slot = s // FAN_IN
                if last and (length, digest) != now:
                    now = (length, digest)
                    if owners.held > TRIE_BYTES:  # nothing in them can grow: the rows are sorted
                        yield from _send(_checked(owners.take_all()), slot, out, kind)
                owners.add(length, digest, body, top, n, row, row_bytes)
                if not last and owners.held > TRIE_BYTES:
                    yield from _send(owners.spill(), slot, out, kind)
        rest = owners.take_all()
        yield from _send(_checked(rest) if last else rest, slot, out, kind)

    return run


def _dealt(docs: DataFrame, row: T.StructType | None, smallest: bool, out: tuple[str, ...]) -> DataFrame:
    """One row for each distinct text, with the columns `out`. `row`: the type of the struct in docs's column `row`."""
    bounded_batches(docs.sparkSession)
    types = {"length": T.LongType(), "digest": T.BinaryType(), "body": T.BinaryType(), "top": T.LongType(), "n": T.LongType(), "slot": T.LongType(), "row": row or T.BooleanType()}
    kind = lambda names: T.StructType([T.StructField(k, types[k]) for k in names])
    rows = docs.select(
        F.octet_length("text").cast("long").alias("length"), F.unhex(F.sha2("text", 256)).alias("digest"), F.col("text").cast("binary").alias("body"), F.col("doc_id").alias("top"),
        F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("slot"), F.col("row") if row else F.lit(None).cast("boolean").alias("row"),
    )
    part = rows.mapInArrow(_merge(True, False, smallest, _COLUMNS), kind(_COLUMNS))
    if likely_partitions(docs) > FAN_IN:
        near = part.repartition("length", "digest", F.expr(f"slot div {FAN_IN}"))
        part = near.mapInArrow(_merge(False, False, smallest, _COLUMNS), kind(_COLUMNS))
    dealt = part.repartition("length", "digest").sortWithinPartitions("length", "digest")
    return dealt.mapInArrow(_merge(False, True, smallest, out), kind(out))


def owners(docs: DataFrame, smallest: bool = False) -> DataFrame:
    """One row for each distinct text: digest (SHA-256), keep_id, group_size."""
    return _dealt(texts(docs), None, smallest, ("digest", "top", "n")).toDF("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, smallest: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest (or smallest) doc_id among equal texts.
    """
    groups = checkpointed(owners(docs, smallest).withColumn("m", F.col("group_size")))
    n = groups.agg(F.sum("m")).first()[0] or 0
    # rows equal in id and text are told apart by their number only
    ids = texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    joined = spread_join(ids, groups, "digest", F.unhex(F.sha2(F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 256)), n)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    each = joined.select("doc_id", "keep_id", "group_size", stays.alias("stays"), "digest", number.alias("copy"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, smallest: bool = False) -> DataFrame:
    """The rows of `docs`, all columns as they are, that exact_dedup() keeps: one for each distinct text.

    The other columns travel with the ids through the tries, so a text is shuffled once, and not once a copy.
    """
    lower = [n.lower() for n in docs.columns]
    at, by = lower.index("text"), lower.index("doc_id")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    others = [f"c{k}" for k in range(len(docs.columns)) if k != at]
    row = F.struct(F.col(f"c{at}").isNull().alias("none"), *others)
    rows = plain.select(F.col(f"c{by}").cast("long").alias("doc_id"), F.coalesce(f"c{at}", F.lit("")).alias("text"), row.alias("row"))
    kept = _dealt(rows, rows.schema["row"].dataType, smallest, ("body", "row"))
    text = F.when(~F.col("row.none"), F.col("body").cast("string"))
    return kept.select(*[(text if k == at else F.col(f"row.c{k}")).alias(n) for k, n in enumerate(docs.columns)])
