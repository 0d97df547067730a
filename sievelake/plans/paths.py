"""Access paths: what a workload makes worth materializing, within a budget.

A query's predicates call for paths: a kind of path and an attribute. A sorted path is the records arranged by
the attribute in a cached columnar table, whose batches carry bounds that a scan skips by; a words or trigrams
path is a cached table of postings, which gives the ids of candidates before records are read. Paths are built
when first called for, scored by use, age and cost of building, and dropped lowest score first when they
outgrow the budget; one whose estimated size is beyond the budget isn't built at all, which is remembered. Every
query can be answered without any of them, so dropping never changes an answer. Records that came after a path was
built are read beside it, and deleted ones left out, so a path outlives changes until the store rewrites its parts.
Paths are arranged by (value, id) or (term, id) ranges, so a common value or term is spread over several tasks.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions import text
from sievelake.plans.compile import apply_query, column
from sievelake.plans.nodes import And, Kind, Node, Predicate, Query, predicates

if TYPE_CHECKING:
    from sievelake.store import Store

#: Which path answers a kind. Sorted and prefix paths both answer equality, so a hash path is built only without them.
PATHS = {
    Kind.EQUALS: ("hash", "sorted", "prefix"), Kind.RANGE: ("sorted",), Kind.PREFIX: ("prefix", "sorted"),
    Kind.CONTAINS: ("words",), Kind.FUZZY: ("trigrams",), Kind.SUBSTRING: ("trigrams",),
    Kind.WITHIN_BOX: ("spatial",), Kind.NEAR: ("spatial",),
}
POSTINGS = ("words", "trigrams")
COST_WEIGHT = 0.1


@dataclass
class Path:
    kind: str
    attribute: str
    epoch: int
    parts: int  # of the store, which it holds
    frame: DataFrame
    size: int
    cost: float
    born: float
    hits: int = 0

    def score(self, now: float) -> float:
        """Uses a second, and a tenth of the seconds that building took."""
        return self.hits / max(now - self.born, 1.0) + COST_WEIGHT * self.cost


@dataclass
class AccessPaths:
    budget: int
    enabled: bool = True
    live: dict[tuple[str, str], Path] = field(default_factory=dict)
    refused: dict[tuple[str, str], tuple[int, int]] = field(default_factory=dict)  # the epoch and parts for which it was too large
    building: set[tuple[str, str]] = field(default_factory=set)
    lock: threading.RLock = field(default_factory=threading.RLock)

    # --- configuration ---

    def set_budget(self, size: int) -> None:
        with self.lock:
            self.budget = size
            self.refused.clear()
            self._evict()

    def inventory(self) -> list[tuple[str, str, int]]:
        with self.lock:
            return [(p.kind, p.attribute, p.size) for p in self.live.values()]

    def _drop(self, key: tuple[str, str]) -> None:
        self.live.pop(key).frame.unpersist()

    def _evict(self) -> None:
        now = time.monotonic()
        while self.live and sum(p.size for p in self.live.values()) > self.budget:
            self._drop(min(self.live, key=lambda k: self.live[k].score(now)))

    # --- building and serving ---

    def serve(self, store: Store, query: Query) -> DataFrame | None:
        """The query's rows by way of paths, or None where the records themselves should be filtered."""
        if not self.enabled or query.where is None:
            return None
        with self.lock:
            for key in [k for k, p in self.live.items() if p.epoch != store.epoch]:
                self._drop(key)
            if self.budget <= 0:
                return None
        used = [p for q in predicates(query.where) if (p := self._path(store, q))]
        with self.lock:
            self._evict()
            used = [p for p in used if self.live.get((p.kind, p.attribute)) is p and p.epoch == store.epoch]
        from sievelake.store import ID

        by = [(p, q) for q in _all_of(query.where) for p in used if p.attribute == q.attribute and p.kind in PATHS[q.kind]]
        postings = [(p, ids) for p, q in by if p.kind in POSTINGS and (ids := _candidates(p, q)) is not None]
        arranged = next((p for p, _ in by if p.kind not in POSTINGS), None)
        if arranged is None and not postings:
            return None
        rows = store.frame() if arranged is None else store.with_later(arranged.frame, arranged.parts)
        for p, ids in postings:
            later = store.since(p.parts)  # which has no postings yet
            rows = rows.join(ids if later is None else ids.unionByName(later.select(ID)), ID, "left_semi")
        return apply_query(rows, query, ID, store.points)  # verifies every candidate

    def _path(self, store: Store, q: Predicate) -> Path | None:
        key = PATHS[q.kind][0], q.attribute
        with self.lock:
            for kind in PATHS[q.kind]:
                if (found := self.live.get((kind, q.attribute))) is not None:
                    found.hits += 1
                    return found
            if key in self.building:  # by another thread, whose path later queries find
                return None
            self.building.add(key)
        try:
            frame, epoch, parts = store.settled()
            if self.refused.get(key) == (epoch, parts):
                return None
            built = _built(store, frame, *key)
            if built is None or _estimate(built, frame) > self.budget:  # it would be dropped as soon as it is there
                self.refused[key] = (epoch, parts)
                return None
            begun = time.monotonic()
            built = built.persist(StorageLevel.MEMORY_AND_DISK)
            built.count()
            now = time.monotonic()
            path = Path(*key, epoch, parts, built, _stated_size(built), now - begun, now)
            with self.lock:
                self.live[key] = path
            return path
        finally:
            with self.lock:
                self.building.discard(key)


UNKNOWN = 1 << 50  # from here on the optimizer could not tell, and starts from the largest number there is


def _stated_size(frame: DataFrame) -> int:
    plan = frame.select("*")._jdf.queryExecution().optimizedPlan()  # a new plan, which knows what is cached by now
    return int(str(plan.stats().sizeInBytes()))


def _estimate(path: DataFrame, records: DataFrame) -> int:
    """About how large a path over the records would be, without building it."""
    stated = _stated_size(path)
    if stated < UNKNOWN:
        return stated
    # only the number of records is counted
    return records.count() * sum(8 if isinstance(f.dataType, T.NumericType) else 24 for f in records.schema.fields)


def _all_of(node: Node) -> list[Predicate]:
    """The predicates that every row of the result meets."""
    if isinstance(node, Predicate):
        return [node]
    return [p for c in node.children for p in _all_of(c)] if isinstance(node, And) else []


def _built(store: Store, frame: DataFrame, kind: str, attribute: str) -> DataFrame | None:
    from sievelake.store import ID

    types = {f.name: f.dataType for f in frame.schema.fields}
    by = store.points.get(attribute, (attribute,))[0] if kind == "spatial" else attribute
    if by not in types or isinstance(types[by], (T.VariantType, T.MapType)):
        return None
    c = column(by)
    if kind not in POSTINGS:
        return frame.repartitionByRange(c, F.col(ID)).sortWithinPartitions(c)
    if not isinstance(types[by], T.StringType):
        return None
    terms = text.words(c) if kind == "words" else text.trigrams(c)
    rows = frame.filter(c.isNotNull()).select(F.explode(F.array_distinct(terms)).alias("term"), F.col(ID))
    return rows.repartitionByRange("term", ID).sortWithinPartitions("term")


def _candidates(path: Path, q: Predicate) -> DataFrame | None:
    """Ids that may meet a text predicate, or None where postings don't narrow it."""
    from sievelake.store import ID

    if q.kind == Kind.CONTAINS:
        return path.frame.filter(F.col("term") == q.args[0].lower()).select(ID)
    if q.kind == Kind.FUZZY:
        return path.frame.filter(F.col("term").isin(text.trigrams_of(q.args[0]))).select(ID).distinct()
    low = q.args[0].lower()
    grams = list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))
    if not grams:  # shorter than a trigram
        return None
    return path.frame.filter(F.col("term").isin(grams)).groupBy(ID).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select(ID)
