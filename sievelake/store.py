"""The record store: schema-flexible rows behind a query builder, with sketches and a graph beside them.

Rows live in DataFrames that are never changed: an insert adds a part, a delete adds ids to leave out, and each
change gives the store a new version. Attributes of all parts are merged by name; one that is of several
families is kept as a VARIANT. MERGE parts of one tier are written together as one of the next tier, so that a
store of very many inserts stays a union of few parts, and a row is rewritten once a tier.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.operators.graph import GraphStore
from sievelake.operators.sketch import BLOOM_BITS, BLOOM_HASHES, COUNT_ROWS, COUNT_WIDTH, BloomSketch, CountMinSketch, bloom_asked, bloom_table, count_asked, count_table
from sievelake.plans.builder import QueryBuilder
from sievelake.plans.compile import apply_query, column, column_family, column_name, family, shape_of
from sievelake.plans.nodes import Query
from sievelake.plans.paths import AccessPaths
from sievelake.shared import checkpointed

ID = "_id"
DEFAULT_BUDGET = 64 << 20
BUFFER_ROWS = 10_000  # single inserts that are kept as Python values before they become a part
MERGE = 16  # parts of one tier, and sets of deleted ids, that are written together
BASE = 1 << 30  # the tier of what the store began with


def merged(parts: list[DataFrame]) -> DataFrame:
    """All rows, attributes matched by name, numbers widened to the widest; an attribute of several families becomes a VARIANT."""
    if len(parts) == 1:
        return parts[0]
    kinds: dict[str, list[T.DataType]] = {}
    for p in parts:
        for f in p.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    mixed = {n for n, ks in kinds.items() if len({column_family(k) if column_family(k) != "list" else k.simpleString() for k in ks}) > 1}
    out = None
    for p in parts:
        cast = p.select(*[(c if isinstance(k, T.VariantType) else c.cast("variant")).alias(n) if n in mixed else c for n, k in ((f.name, f.dataType) for f in p.schema.fields) for c in [column(n)]])
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    assert out is not None
    return out


def rows_frame(spark: SparkSession, rows: list[tuple[int, Mapping[str, Any]]]) -> DataFrame:
    """Python records as a DataFrame. An attribute whose values are of several families is split and merged."""
    shapes: dict[tuple, list[tuple[int, Mapping[str, Any]]]] = {}
    families: dict[str, set] = {}
    for _, attrs in rows:
        for k, v in attrs.items():
            families.setdefault(k, set()).add(_signature(v))
    mixed = {k for k, fs in families.items() if len(fs - {("list",)}) > 1 or ("list",) in fs and any(f[0] != "list" for f in fs)}
    for i, attrs in rows:
        shapes.setdefault(tuple(sorted((k, str(_signature(v))) for k, v in attrs.items() if k in mixed)), []).append((i, attrs))
    parts = []
    for group in shapes.values():
        names: dict[str, T.DataType] = {}
        empty: set[str] = set()
        for _, attrs in group:
            for k, v in attrs.items():
                if k not in names or k in empty:  # an empty list takes the type of the others
                    names[k] = _kind(v)
                (empty.add if v in ([], ()) else empty.discard)(k)
        schema = T.StructType([T.StructField(ID, T.LongType(), False), *(T.StructField(k, t) for k, t in names.items())])
        parts.append(spark.createDataFrame([(i, *(_plain(a.get(k)) for k in names)) for i, a in group], schema))
    return merged(parts)


def _signature(v: Any) -> Any:
    f = family(v)
    return (f, *sorted({str(_signature(x)) for x in v})) if f == "list" else (f,)


def _kind(v: Any) -> T.DataType:
    f = family(v)
    if f == "list":
        inner = {family(x) for x in v}
        return T.ArrayType(T.DoubleType() if inner <= {"int", "float"} and "float" in inner else _kind(v[0]) if v else T.StringType())
    if f is None:
        raise TypeError(f"a value of type {type(v).__name__} can't be an attribute")
    return {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType()}[f]


def _plain(v: Any) -> Any:
    if isinstance(v, (list, tuple)):
        return [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and any(isinstance(y, float) for y in v) else _plain(x) for x in v]
    return v


class Store:
    def __init__(self, spark: SparkSession, memory_budget: int | None = None) -> None:
        self.spark = spark
        self.graph = GraphStore(spark)
        self.paths = AccessPaths(DEFAULT_BUDGET if memory_budget is None else memory_budget)
        self.version = 0
        self.points: dict[str, tuple[str, str]] = {}
        self.epoch = 0  # of the list of parts: it only grows within one
        self.bloom_size, self.count_size = (BLOOM_BITS, BLOOM_HASHES), (COUNT_ROWS, COUNT_WIDTH)
        self._parts: list[DataFrame] = []
        self._tiers: list[int] = []
        self._lost: list[dict[str, Any]] = []
        self._buffer: list[tuple[int, dict[str, Any]]] = []
        self._gone: set[int] = set()
        self._gone_frames: list[DataFrame] = []
        self._next = 0
        self._sketches: dict[tuple, Any] = {}
        self._frame: tuple[int, DataFrame] | None = None
        self._lock = threading.RLock()

    @classmethod
    def from_df(cls, df: DataFrame, id: str | None = None, points: Mapping[str, tuple[str, str]] | None = None, memory_budget: int | None = None) -> Store:  # noqa: A002
        """A store over a DataFrame, read lazily. `id`: a unique integer column; without it ids are given in order.

        points: names for pairs of columns that hold a point's x and y; only such pairs can be pushed to a scan.
        """
        out = cls(df.sparkSession, memory_budget)
        out.points = dict(points or {})
        if id is None:
            out.insert_frame(df)
        else:
            out.start_with(df.withColumn(ID, column(id).cast("bigint")), -1)  # found when an id is to be given
        return out

    # --- changes ---

    def _changed(self) -> None:
        self.version += 1
        self._frame = None

    def _take_ids(self, n: int) -> int:
        if self._next < 0:
            top = self._history().agg(F.max(ID)).first()[0]
            self._next = 0 if top is None else top + 1
        self._next += n
        return self._next - n

    def insert(self, attrs: Mapping[str, Any]) -> int:
        """Add one record and give its id: the next one, never one that was used."""
        with self._lock:
            for v in attrs.values():
                _kind(v)
            new = self._take_ids(1)
            self._buffer.append((new, dict(attrs)))
            if len(self._buffer) >= BUFFER_ROWS:
                self._flush()
            self._changed()
            return new

    def insert_many(self, records: Iterable[Mapping[str, Any]]) -> list[int]:
        return [self.insert(r) for r in records]

    def insert_frame(self, df: DataFrame) -> range:
        """Add all rows of a DataFrame. Ids are contiguous: each partition gets a base from the sizes of those before."""
        with self._lock:
            self._flush()
            pos, place, size, base = "sievelake pos", "sievelake partition", "sievelake size", "sievelake base"
            fixed = checkpointed(df.withColumn(pos, F.monotonically_increasing_id()))
            of = F.shiftright(F.col(pos), 33)
            # one row for each partition, here and in the broadcast
            sizes = fixed.groupBy(of.alias(place)).agg(F.count(F.lit(1)).alias(size)).toArrow().sort_by(place)
            counts = sizes.column(size).to_numpy()
            total = int(counts.sum())
            first = self._take_ids(total)
            bases = self.spark.createDataFrame(pa.table({place: sizes.column(place), base: first + np.cumsum(counts) - counts}))
            told = fixed.join(F.broadcast(bases), of == F.col(place))
            within = F.col(pos).bitwiseAND(F.lit((1 << 33) - 1))
            self._add_part(told.select((F.col(base) + within).alias(ID), *[fixed[column_name(c)] for c in df.columns]))
            self._changed()
            return range(first, first + total)

    def start_with(self, frame: DataFrame, next_id: int) -> None:
        """Take a frame with ids as what the store holds; next_id below 0: one more than its largest id."""
        with self._lock:
            self._parts, self._tiers, self._buffer, self._gone, self._gone_frames, self._lost = [frame], [BASE], [], set(), [], []
            self._next = next_id
            self.epoch += 1
            self._changed()

    def _add_part(self, part: DataFrame) -> None:
        tier = 0
        self._parts.append(part)
        self._tiers.append(tier)
        while self._tiers[-MERGE:] == [tier] * MERGE:
            whole = checkpointed(merged(self._parts[-MERGE:]))
            tier += 1
            self._parts[-MERGE:], self._tiers[-MERGE:] = [whole], [tier]
            self.epoch += 1

    def delete(self, id: int) -> bool:  # noqa: A002
        """Remove a record and all edges that touch it; False if there is none. Sketches still know its values."""
        with self._lock:
            if self.frame().filter(F.col(ID) == id).isEmpty():
                return False
            kept = [(i, a) for i, a in self._buffer if i != id]
            if len(kept) < len(self._buffer):
                self._forgotten([a for i, a in self._buffer if i == id])
                self._buffer = kept
            else:
                self._gone.add(id)
            self.graph.remove_node(id)
            self._changed()
            return True

    def delete_many(self, ids: DataFrame) -> None:
        """Remove the records whose ids are in a one-column DataFrame."""
        with self._lock:
            self._flush()
            gone = checkpointed(ids.select(F.col(ids.columns[0]).cast("bigint").alias(ID)).distinct())
            self._gone_frames.append(gone)
            if len(self._gone_frames) >= MERGE:
                self._gone_frames = [checkpointed(reduce(DataFrame.unionByName, self._gone_frames).distinct())]
            self.graph.remove_nodes(gone)
            self._changed()

    def _forgotten(self, attrs: list[dict[str, Any]]) -> None:
        """Values of records that went before they became a part: sketches keep them."""
        self._lost = [*self._lost, *attrs]

    def _flush(self) -> None:
        if self._buffer:
            rows, self._buffer = rows_frame(self.spark, self._buffer), []
            self._add_part(rows)

    # --- reads ---

    def _all_parts(self) -> list[DataFrame]:
        return [*self._parts, *([rows_frame(self.spark, self._buffer)] if self._buffer else [])]

    def _history(self) -> DataFrame:
        """All that was ever inserted."""
        parts = self._all_parts()
        if self._lost:
            parts.append(rows_frame(self.spark, [(-1, a) for a in self._lost]))
        return merged(parts) if parts else self.spark.createDataFrame([], f"{ID} bigint")

    def frame(self) -> DataFrame:
        """The live records, with their ids."""
        with self._lock:
            if self._frame is None or self._frame[0] != self.version:
                parts = self._all_parts()
                self._frame = (self.version, self._live(merged(parts)) if parts else self.spark.createDataFrame([], f"{ID} bigint"))
            return self._frame[1]

    def _live(self, rows: DataFrame) -> DataFrame:
        if self._gone:
            rows = rows.filter(~F.col(ID).isin(sorted(self._gone))) if len(self._gone) <= 1000 else rows.join(self.spark.createDataFrame(pa.table({ID: sorted(self._gone)})), ID, "left_anti")
        return rows.join(reduce(DataFrame.unionByName, self._gone_frames), ID, "left_anti") if self._gone_frames else rows

    def settled(self) -> tuple[DataFrame, int, int]:
        """The live records, the epoch, and the number of parts that hold them: what an access path is built from."""
        with self._lock:
            self._flush()
            return self.frame(), self.epoch, len(self._parts)

    def since(self, parts: int) -> DataFrame | None:
        """All records that came after so many parts of this epoch, or None."""
        with self._lock:
            more = self._all_parts()[parts:]
            return merged(more) if more else None

    def with_later(self, rows: DataFrame, parts: int) -> DataFrame:
        """The live records, from those of so many parts and all that came after."""
        with self._lock:
            more = self.since(parts)
            return self._live(rows if more is None else merged([rows, more]))

    def get(self, id: int) -> dict[str, Any] | None:  # noqa: A002
        """A record's attributes, without those that it lacks; None for an unknown id."""
        found = self.frame().filter(F.col(ID) == id).limit(1).collect()
        if not found:
            return None
        row = found[0].asDict(recursive=True)
        return {k: v.toPython() if isinstance(found[0][k], T.VariantVal) else v for k, v in row.items() if k != ID and v is not None}

    def __len__(self) -> int:
        return self.frame().count()

    def is_empty(self) -> bool:
        return self.frame().isEmpty()

    def find(self) -> QueryBuilder:
        return QueryBuilder(self)

    def execute(self, query: Query, with_id: bool = False) -> DataFrame:
        """The rows of a query. An access path may serve it; which one never changes the rows."""
        out = self.paths.serve(self, query)
        if out is None:
            out = apply_query(self.frame(), query, ID, self.points)
        return out if with_id else out.drop(ID)

    # --- sketches ---

    def _sketch(self, kind: type, attribute: str) -> Any:
        with self._lock:
            key = (kind, attribute, self.version)
            if key not in self._sketches:
                history = self._history()
                if attribute not in history.columns or attribute == ID:
                    return None
                self._sketches = {k: v for k, v in self._sketches.items() if k[2] == self.version}
                self._sketches[key] = kind.of(history, attribute, *(self.bloom_size if kind is BloomSketch else self.count_size))
            return self._sketches[key]

    def maybe_contains(self, attribute: str, value: Any) -> bool:
        """False only if no record ever had the value."""
        found = self._sketch(BloomSketch, attribute)
        return found is not None and found.maybe_contains(value)

    def estimate_count(self, attribute: str, value: Any) -> int:
        """How many records ever had the value, or more."""
        found = self._sketch(CountMinSketch, attribute)
        return 0 if found is None else found.estimate(value)

    def maybe_contains_each(self, attribute: str, values: DataFrame) -> DataFrame:
        """The same of all distinct values in a DataFrame's column of that name, with the answers as column maybe."""
        return bloom_asked(bloom_table(self._history(), attribute, *self.bloom_size), values, attribute, *self.bloom_size)

    def estimate_count_each(self, attribute: str, values: DataFrame) -> DataFrame:
        """The same of all distinct values in a DataFrame's column of that name, with the answers as column estimate."""
        return count_asked(count_table(self._history(), attribute, *self.count_size), values, attribute, *self.count_size)

    def size_sketches(self, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES, rows: int = COUNT_ROWS, width: int = COUNT_WIDTH) -> None:
        """Sizes of the sketches from now on: bits and hashes of Bloom, rows and width of Count-Min ones."""
        if min(bits, hashes, rows, width) < 1 or rows > 256:
            raise ValueError("sketch sizes are 1 at least, and at most 256 rows")
        with self._lock:
            self.bloom_size, self.count_size = (bits, hashes), (rows, width)
            self._sketches = {}

    def rebuild_sketches(self) -> None:
        """Forget values of deleted records, as a save and load does."""
        with self._lock:
            self._take_ids(0)
            self.start_with(self.frame(), self._next)

    # --- graph ---

    def add_edge(self, a: int, b: int, label: str | None = None, directed: bool = False) -> None:
        self.graph.add_edge(a, b, label, directed)

    def add_weighted_edge(self, a: int, b: int, weight: float, label: str | None = None, directed: bool = False) -> None:
        self.graph.add_weighted_edge(a, b, weight, label, directed)

    def remove_edge(self, a: int, b: int, label: str | None = None, directed: bool = False) -> None:
        self.graph.remove_edge(a, b, label, directed)

    def neighbors(self, id: int, label: str | None = None) -> DataFrame:  # noqa: A002
        return self.graph.neighbors(id, label)

    def weighted_neighbors(self, id: int, label: str | None = None) -> DataFrame:  # noqa: A002
        return self.graph.weighted_neighbors(id, label)

    def bfs(self, start: int, max_depth: int | None = None, label: str | None = None) -> DataFrame:
        return self.graph.bfs(start, max_depth, label)

    def shortest_path(self, source: int, target: int, label: str | None = None) -> list[int] | None:
        return self.graph.shortest_path(source, target, label)

    def dijkstra(self, source: int, label: str | None = None) -> DataFrame:
        return self.graph.dijkstra(source, label)

    def shortest_path_weighted(self, source: int, target: int, label: str | None = None) -> tuple[list[int], float] | None:
        return self.graph.shortest_path_weighted(source, target, label)

    def pagerank(self, damping: float = 0.85, iterations: int = 30) -> DataFrame:
        return self.graph.pagerank(damping, iterations)

    # --- configuration and snapshots ---

    def set_memory_budget(self, size: int) -> None:
        self.paths.set_budget(size)

    def index_inventory(self) -> list[tuple[str, str, int]]:
        """(type, attribute, bytes) of what is materialized now."""
        return self.paths.inventory()

    def save(self, path: str, format: str = "parquet") -> None:  # noqa: A002
        from sievelake.sources import snapshot

        snapshot.save(self, path, format)

    @classmethod
    def load(cls, spark: SparkSession, path: str, memory_budget: int | None = None, format: str = "parquet") -> Store:  # noqa: A002
        from sievelake.sources import snapshot

        return snapshot.load(spark, path, memory_budget, format)

    def explain(self, query: Query) -> str:
        """The physical plan of a query without access paths."""
        plan = apply_query(self.frame(), query, ID, self.points)
        return plan._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    @property
    def shape(self):  # noqa: ANN201
        return shape_of(self.frame(), self.points)
