"""Weighted paths: simple, the same on the driver and in DataFrames, and those of brute force."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from sievelake.operators import graph as m


def both(spark, edges):
    frame = spark.createDataFrame([(s, d, None, float(w)) for s, d, w in edges], m.EDGES)
    return m.GraphStore(spark, frame), m.GraphStore(spark, frame, local_edges=0)


def brute(edges, start, target):
    """The lightest simple path of the fewest edges; of these, from the target back, the lowest predecessors."""
    best = {}
    for s, d, w in edges:
        best[s, d] = min(w, best.get((s, d), math.inf))
    nodes = {x for e in edges for x in e[:2]} - {start, target}
    found = []
    for n in range(len(nodes) + 1):
        for middle in itertools.permutations(nodes, n):
            path = [start, *middle, target]
            weight = sum(best.get(e, math.inf) for e in itertools.pairwise(path))
            if weight < math.inf:
                found.append((weight, len(path), path[::-1], path))
    return min(found)[3] if found else None


def test_paths_over_edges_of_no_weight_are_simple(spark):
    here, there = both(spark, [(9, 5, 1), (5, 2, 0), (2, 5, 0), (5, 7, 1)])
    assert here.shortest_path_weighted(9, 7) == there.shortest_path_weighted(9, 7) == ([9, 5, 7], 2.0)


@pytest.mark.parametrize("seed", range(12))
def test_local_paths_are_those_of_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(7), rnd.randrange(7), rnd.choice([0, 0, 1, 2])) for _ in range(14)]
    here, _ = both(spark, edges)
    for target in range(1, 7):
        got = here.shortest_path_weighted(0, target)
        assert (got and got[0]) == brute(edges, 0, target)


def test_joined_paths_are_the_local_ones(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(20), rnd.randrange(20), rnd.choice([0, 0, 1, 3])) for _ in range(45)]
    here, there = both(spark, edges)
    for target in (3, 11, 17):
        assert here.shortest_path_weighted(0, target) == there.shortest_path_weighted(0, target)


def test_more_steps_than_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(m, "MANY", 2)
    here, there = both(spark, [(i, i + 1, 1) for i in range(7)] + [(0, 6, 9.0)])
    as_dict = lambda df: {r[0]: r[1] for r in df.collect()}
    assert as_dict(there.bfs(0)) == as_dict(here.bfs(0)) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 2}
    assert as_dict(there.dijkstra(0)) == as_dict(here.dijkstra(0)) == {i: float(i) for i in range(8)}


def test_infinite_weights_end_a_walk(spark):
    for g in both(spark, [(0, 1, 1), (1, 2, math.inf), (2, 3, 1)]):
        assert {r[0]: r[1] for r in g.dijkstra(0).collect()} == {0: 0.0, 1: 1.0, 2: math.inf}
        assert g.shortest_path_weighted(0, 2) is None


def test_rows_without_an_end_or_a_weight(spark):
    g = m.GraphStore(spark, spark.createDataFrame([(1, 2, None, None), (1, None, None, 1.0), (None, 2, "x", 1.0)], m.EDGES))
    assert [tuple(r) for r in g.edges().collect()] == [(1, 2, None, 1.0)]
    assert [tuple(r) for r in g.weighted_neighbors(1).collect()] == [(2, 1.0)] and g.shortest_path_weighted(1, 2) == ([1, 2], 1.0)


def test_a_thousand_predecessors(spark):
    edges = [(0, i, 1) for i in range(1, 1102)] + [(i, 5000, 0) for i in range(1, 1102)]
    assert both(spark, edges)[1].shortest_path_weighted(0, 5000) == ([0, 1, 5000], 1.0)
