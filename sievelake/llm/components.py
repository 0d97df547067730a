"""Connected components by alternating large and small stars, as DataFrame steps of bounded depth.

Each round takes the least neighbour of every node by an aggregation (combined before the shuffle) and joins it
back to the edges, so that no task has all edges of a node with very many. Rounds end when the edges are stars
around the least node of each component, which those that begin so are at once; each is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import checkpointed, spread_join

ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The pairs with `low`, the least b that their a has, and those lows: a, low."""
    least = pairs.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("m"))
    return spread_join(pairs, least, "a", _both(pairs), n).select("a", "b", "low"), least.select("a", "low")


def _both(pairs: DataFrame) -> Column:
    """A hash of a and b, of their type where that is binary or bigint."""
    kind = dict(pairs.dtypes)["a"]
    return F.unhex(F.md5(F.concat("a", "b"))) if kind == "binary" else F.xxhash64("a", "b") if kind == "bigint" else F.col("b")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours are tied to the least of its neighbours and itself."""
    tied, _ = _with_least(_both_ways(edges), n)
    return tied.filter("b > a").select(F.least("low", "a").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    tied, lows = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), n)
    both = tied.select(F.col("low").alias("a"), "b").unionByName(lows.select(F.col("low").alias("a"), F.col("a").alias("b")))
    return both.filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each b has one a, and no a is a b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("is_a"), F.lit(0).alias("as_b")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("is_a"), F.lit(1).alias("as_b")))
    nodes = ends.groupBy("node").agg(F.max("is_a").alias("is_a"), F.sum("as_b").alias("as_b"))
    return nodes.filter("as_b > 1 OR is_a = 1 AND as_b > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component), for every node with an edge. `edges`: columns a, b of any ordered type."""
    now = checkpointed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(ROUNDS):
        n = now.count()
        if not n or _are_stars(now):
            break
        now = checkpointed(_small_star(_large_star(now, n), n))
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("root")))
