"""A labelled, weighted, directed graph as a DataFrame of edges, and walks over it.

Edges are src, dst, label (or null) and weight, one for each (src, dst, label); nodes are what edges name.
Walks choose by size: up to LOCAL_EDGES edges (counted no further than that) are taken to the driver and walked
there as flat arrays, which for small graphs saves a job a step. Beyond, each step is a join of the frontier with
the edges, combined before its shuffle; only what a step adds is written, and read again from there. Both give the
same answers: a lightest path is one of the fewest edges among those, and where several paths tie, each node's
predecessor on the path is the lowest that can be. Edges of a weight below 0 are not walked; one of an infinite
weight (or NaN) is walked, but not beyond.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.shared import checkpointed

EDGES = "src bigint, dst bigint, label string, weight double"
LOCAL_EDGES = 100_000
MANY = 16  # written steps that are read one by one; more are written together


def typed(edges: DataFrame) -> DataFrame:
    """The columns of EDGES. A row that lacks an end is no edge; one that lacks its weight has 1."""
    named = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.col("label").cast("string"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    return named.filter("src IS NOT NULL AND dst IS NOT NULL")


class GraphStore:
    def __init__(self, spark: SparkSession, edges: DataFrame | None = None, local_edges: int = LOCAL_EDGES) -> None:
        self.spark = spark
        self.local_edges = local_edges
        self._base = None if edges is None else typed(edges)
        self._added: dict[tuple[int, int, str | None], float] = {}
        self._walk: LocalEdges | None = None
        self._asked = False

    # --- changes ---

    def add_edge(self, a: int, b: int, label: str | None = None, directed: bool = False) -> None:
        self.add_weighted_edge(a, b, 1.0, label, directed)

    def add_weighted_edge(self, a: int, b: int, weight: float, label: str | None = None, directed: bool = False) -> None:
        """Also sets the weight of an edge that is there. Undirected edges are kept in both directions."""
        for pair in ((a, b),) if directed else ((a, b), (b, a)):
            self._added[(*pair, label)] = float(weight)
        self._asked = False

    def add_edges(self, edges: DataFrame, directed: bool = True) -> None:
        """Many at once: columns src, dst, label, weight. Of rows with one key the heaviest counts; it replaces what is there."""
        new = typed(edges)
        if not directed:
            new = new.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight"))
        self._merge(new.groupBy("src", "dst", "label").agg(F.max("weight").alias("weight")))

    def _merge(self, new: DataFrame) -> None:
        if self._base is not None or self._added:
            old = self.edges()
            both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
            new = both.groupBy("src", "dst", "label").agg(F.max_by("weight", "turn").alias("weight"))
        self._added.clear()
        self._base = new
        self._asked = False

    def remove_edge(self, a: int, b: int, label: str | None = None, directed: bool = False) -> None:
        """The edge with exactly this label (None: the one without)."""
        pairs = {(a, b)} if directed else {(a, b), (b, a)}
        match = F.lit(False)
        for s, d in pairs:
            match = match | ((F.col("src") == s) & (F.col("dst") == d))
        self._drop(match & F.col("label").eqNullSafe(F.lit(label).cast("string")), lambda k: k[:2] in pairs and k[2] == label)

    def remove_node(self, node: int) -> None:
        """All edges that touch it, in either direction."""
        self._drop((F.col("src") == node) | (F.col("dst") == node), lambda k: node in k[:2])

    def remove_nodes(self, nodes: DataFrame) -> None:
        """The same for many: a DataFrame of one column of ids."""
        ids = nodes.select(F.col(nodes.columns[0]).cast("bigint").alias("gone"))
        edges = self.edges()
        self._added.clear()
        self._base = edges.join(ids, F.col("src") == F.col("gone"), "left_anti").join(ids, F.col("dst") == F.col("gone"), "left_anti")
        self._asked = False

    def _drop(self, match: Column, local) -> None:  # noqa: ANN001
        if self._base is not None:
            self._base = self._base.filter(~match)
        self._added = {k: w for k, w in self._added.items() if not local(k)}
        self._asked = False

    # --- reads ---

    def edges(self) -> DataFrame:
        """All edges; an undirected one shows in both directions."""
        if not self._added:
            return self._base if self._base is not None else self.spark.createDataFrame([], EDGES)
        new = self.spark.createDataFrame([(*k, w) for k, w in self._added.items()], EDGES)
        if self._base is None:
            return new
        both = self._base.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
        return both.groupBy("src", "dst", "label").agg(F.max_by("weight", "turn").alias("weight"))

    def _selected(self, label: str | None) -> DataFrame:
        edges = self.edges()
        return edges if label is None else edges.filter(F.col("label") == label)

    def neighbors(self, node: int, label: str | None = None) -> DataFrame:
        """id of each node that an edge from `node` leads to; without a label, by any."""
        return self._selected(label).filter(F.col("src") == node).select(F.col("dst").alias("id")).distinct()

    def weighted_neighbors(self, node: int, label: str | None = None) -> DataFrame:
        """id and weight of each edge from `node`; parallel edges of several labels show one by one."""
        return self._selected(label).filter(F.col("src") == node).select(F.col("dst").alias("id"), "weight")

    def local(self) -> LocalEdges | None:
        """All edges as arrays, if they are few."""
        if not self._asked:
            if self._base is None:
                rows = [(*k, w) for k, w in self._added.items()]
                table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["src", "dst", "label", "weight"])
            else:
                table = self.edges().limit(self.local_edges + 1).toArrow()
            self._walk = LocalEdges(table) if table.num_rows <= self.local_edges else None
            self._asked = True
        return self._walk

    def _frame(self, **columns: np.ndarray) -> DataFrame:
        """What the driver has found, as one partition."""
        return self.spark.createDataFrame(pa.table(columns)).coalesce(1)

    # --- fewest steps ---

    def bfs(self, start: int, max_depth: int | None = None, label: str | None = None) -> DataFrame:
        """id and depth of what can be reached; the start itself has depth 0, known or not."""
        if (here := self.local()) is not None:
            if (first := here.number(start)) is None:
                return self._frame(id=np.array([start], np.int64), depth=np.zeros(1, np.int32))
            depth, _ = steps(here.leaving(label), first, max_depth)
            reached = np.flatnonzero(depth >= 0)
            return self._frame(id=here.ids[reached], depth=depth[reached])
        seen, _ = self._wave(self._selected(label), start, max_depth, None)
        return seen.select("id", "depth")

    def shortest_path(self, start: int, target: int, label: str | None = None) -> list[int] | None:
        """A path of the fewest edges, or None."""
        if start == target:
            return [start]
        if (here := self.local()) is not None:
            return here.path(here.leaving(label), start, target)
        return self._traced(self._selected(label), start, target)

    def _traced(self, edges: DataFrame, start: int, target: int) -> list[int] | None:
        seen, depth = self._wave(edges, start, None, target)
        if depth is None:
            return None
        path = [target]
        while path[-1] != start:  # one lookup a step back
            path.append(seen.filter((F.col("id") == path[-1]) & (F.col("depth") == depth)).first()["parent"])
            depth -= 1
        return path[::-1]

    def _wave(self, edges: DataFrame, start: int, max_depth: int | None, target: int | None) -> tuple[DataFrame, int | None]:
        """id, depth and parent of what can be reached, and the target's depth. A step writes only the nodes that it finds."""
        edges = edges.select("src", "dst").distinct().persist()
        frontier = self.spark.sql(f"SELECT CAST({int(start)} AS BIGINT) AS id, 0 AS depth, CAST(NULL AS BIGINT) AS parent")
        seen, found = [frontier], None
        for depth in itertools.count(1):  # ends, since each step needs nodes that are new
            if max_depth is not None and depth > max_depth:
                break
            near = edges.join(frontier.select("id"), F.col("src") == F.col("id")).groupBy(F.col("dst").alias("next")).agg(F.min("src").alias("parent"))
            fresh = near.join(all_of(seen).select("id"), F.col("next") == F.col("id"), "left_anti")
            frontier = checkpointed(fresh.select(F.col("next").alias("id"), F.lit(depth).alias("depth"), "parent"))
            if frontier.isEmpty():
                break
            seen.append(frontier)
            if target is not None and not frontier.filter(F.col("id") == target).isEmpty():
                found = depth
                break
            if len(seen) > MANY:
                seen = [checkpointed(all_of(seen))]
        edges.unpersist()
        return all_of(seen), found

    # --- least weight ---

    def dijkstra(self, start: int, label: str | None = None) -> DataFrame:
        """id and dist of what can be reached by edges of weight 0 or more."""
        if (here := self.local()) is not None:
            if (first := here.number(start)) is None:
                return self._frame(id=np.array([start], np.int64), dist=np.zeros(1))
            dist, known = distances(here.leaving(label), first)
            return self._frame(id=here.ids[known], dist=dist[known])
        return self._relaxed(start, label)

    def shortest_path_weighted(self, start: int, target: int, label: str | None = None) -> tuple[list[int], float] | None:
        """A lightest path (of the fewest edges among those) and its weight, or None."""
        if start == target:
            return [start], 0.0
        if (here := self.local()) is not None:
            return here.lightest(here.leaving(label), start, target)
        dist = self._relaxed(start, label).filter("dist < double('inf')").persist()
        end = dist.filter(F.col("id") == target).first()
        if end is None:
            return None
        # edges by which a node is reached at its distance; the path of the fewest of them never goes through a node twice
        tight = self._usable(label).join(dist.withColumnsRenamed({"id": "src", "dist": "from"}), "src").join(dist.withColumnsRenamed({"id": "dst", "dist": "to"}), "dst").filter(F.col("from") + F.col("weight") == F.col("to"))
        path = self._traced(tight, start, target)
        dist.unpersist()
        return None if path is None else (path, end["dist"])

    def _usable(self, label: str | None) -> DataFrame:
        return self._selected(label).filter("NOT weight < 0").select("src", "dst", F.when(F.isnan("weight"), math.inf).otherwise(F.col("weight")).alias("weight"))

    def _relaxed(self, start: int, label: str | None) -> DataFrame:
        """id and dist. A round writes only the distances that it has shortened."""
        edges = self._usable(label).groupBy("src", "dst").agg(F.min("weight").alias("weight")).persist()
        changed = self.spark.sql(f"SELECT CAST({int(start)} AS BIGINT) AS id, 0.0D AS dist")
        told = [changed]
        least = lambda: all_of(told).groupBy("id").agg(F.min("dist").alias("dist"))
        while True:  # ends after as many rounds as a lightest path has edges
            ready = changed.filter("dist < double('inf')")
            step = edges.join(ready, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("next")).agg(F.min(F.col("dist") + F.col("weight")).alias("new"))
            shorter = step.join(least(), F.col("next") == F.col("id"), "left").filter("dist IS NULL OR new < dist")
            changed = checkpointed(shorter.select(F.col("next").alias("id"), F.col("new").alias("dist")))
            if changed.isEmpty():
                edges.unpersist()
                return least()
            told.append(changed)
            if len(told) > MANY:
                told = [checkpointed(least())]

    # --- rank ---

    def pagerank(self, damping: float = 0.85, iterations: int = 30) -> DataFrame:
        """id and rank of every node an edge names, after exactly so many rounds."""
        if (here := self.local()) is not None:
            return self._frame(id=here.ids, rank=here.ranks(damping, iterations))
        edges = self.edges()
        sums = edges.groupBy("src").agg(F.sum("weight").alias("out"))
        shares = edges.join(sums.filter("out > 0 AND NOT isnan(out)"), "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")).groupBy("src", "dst").agg(F.sum("share").alias("share")).persist()
        nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        # a node whose weights sum to exactly 0, or that has none, gives its rank to all
        nodes = checkpointed(nodes.join(sums, F.col("id") == F.col("src"), "left").select("id", (F.coalesce("out", F.lit(0.0)) == 0.0).alias("dangles")))
        n = nodes.count()
        ranks = nodes.select("id", "dangles", F.lit(1.0 / n if n else 0.0).alias("rank"))
        kept: list[DataFrame] = []
        for k in range(iterations if n else 0):
            loose = ranks.filter("dangles").agg(F.sum("rank")).first()[0] or 0.0
            while len(kept) > 1:  # the last round's ranks are there by now
                kept.pop(0).unpersist()
            base = (1 - damping) / n + damping * loose / n
            given = shares.join(ranks.select("id", "rank"), F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            ranks = nodes.join(given, F.col("id") == F.col("to"), "left").select("id", "dangles", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
            if k % 5 == 4 or k == iterations - 1:
                ranks = checkpointed(ranks)
            else:
                ranks = ranks.persist()
                kept.append(ranks)
        for old in [*kept, shares]:
            old.unpersist()
        return ranks.select("id", "rank")


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- the same on the driver, for few edges ------------------------------------------------------------


@dataclass
class Leaving:
    """Edges between numbered nodes, those that leave one node next to each other, ordered by their ends."""

    first: np.ndarray  # of each node's edges; one entry more than nodes
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """The places of the edges that leave these nodes."""
        n = self.first[nodes + 1] - self.first[nodes]
        return np.repeat(self.first[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def only(self, which: np.ndarray) -> Leaving:
        src = self.src[which]
        return Leaving(np.searchsorted(src, np.arange(len(self.first))), src, self.dst[which], self.weight[which])


def steps(edges: Leaving, start: int, max_depth: int | None = None, target: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Each node's depth (-1: not reached) and lowest predecessor, in waves up to the target."""
    depth, parent = np.full(len(edges.first) - 1, -1, np.int32), np.full(len(edges.first) - 1, -1)
    depth[start] = 0
    wave = np.array([start])
    for d in itertools.count(1):
        if not len(wave) or max_depth is not None and d > max_depth or target >= 0 and depth[target] >= 0:
            return depth, parent
        at = edges.of(wave)
        at = at[depth[edges.dst[at]] < 0]
        wave, one = np.unique(edges.dst[at], return_index=True)  # of equal ends the first edge, which has the lowest start
        depth[wave], parent[wave] = d, edges.src[at[one]]


def distances(edges: Leaving, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's distance, and the numbers of those that are reached. Only nodes that came nearer pass it on."""
    edges = edges.only(~(edges.weight < 0))
    weight = np.where(np.isnan(edges.weight), np.inf, edges.weight)
    dist, known = np.full(len(edges.first) - 1, np.inf), np.zeros(len(edges.first) - 1, bool)
    dist[start], known[start] = 0.0, True
    nearer = np.array([start])
    while len(nearer):
        at = edges.of(nearer)
        to, new = edges.dst[at], dist[edges.src[at]] + weight[at]
        known[to] = True
        nearer = np.unique(to[new < dist[to]])
        np.minimum.at(dist, to, new)
    return dist, np.flatnonzero(known)


class LocalEdges:
    def __init__(self, table: pa.Table) -> None:
        src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        self.ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
        src, dst = ends[: len(src)], ends[len(src) :]
        order = np.lexsort((dst, src))
        self.labels = table.column("label").take(pa.array(order))
        src = src[order]
        self.all = Leaving(np.searchsorted(src, np.arange(len(self.ids) + 1)), src, dst[order], weight[order])

    def number(self, node: int) -> int | None:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else None

    def leaving(self, label: str | None) -> Leaving:
        return self.all if label is None else self.all.only(pc.equal(self.labels, label).fill_null(False).to_numpy())

    def path(self, edges: Leaving, start: int, target: int) -> list[int] | None:
        first, last = self.number(start), self.number(target)
        if first is None or last is None:
            return None
        depth, parent = steps(edges, first, target=last)
        if depth[last] < 0:
            return None
        back = [last]
        while back[-1] != first:
            back.append(int(parent[back[-1]]))
        return self.ids[back[::-1]].tolist()

    def lightest(self, edges: Leaving, start: int, target: int) -> tuple[list[int], float] | None:
        first, last = self.number(start), self.number(target)
        if first is None or last is None:
            return None
        dist, _ = distances(edges, first)
        if np.isinf(dist[last]):
            return None
        tight = np.isfinite(dist[edges.src]) & ~(edges.weight < 0) & (dist[edges.src] + edges.weight == dist[edges.dst])
        path = self.path(edges.only(tight), start, target)
        return None if path is None else (path, float(dist[last]))

    def ranks(self, damping: float, iterations: int) -> np.ndarray:
        e, n = self.all, len(self.ids)
        out = np.bincount(e.src, e.weight, n)
        loose, gives = out == 0, out[e.src] > 0
        src, dst, share = e.src[gives], e.dst[gives], e.weight[gives] / out[e.src[gives]]
        rank = np.full(n, 1.0 / n if n else 0.0)
        for _ in range(iterations if n else 0):
            rank = (1 - damping) / n + damping * rank[loose].sum() / n + damping * np.bincount(dst, rank[src] * share, n)
        return rank
