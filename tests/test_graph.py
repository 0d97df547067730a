"""Walks on the driver and in DataFrames, which must agree."""

from __future__ import annotations

import math
import random

import pytest

from sievelake.operators.graph import GraphStore

LOCAL, SPREAD = 100_000, -1


def graph(spark, limit, edges=(), directed=True):
    g = GraphStore(spark, local_edges=limit)
    for e in edges:
        g.add_weighted_edge(e[0], e[1], e[2] if len(e) > 2 else 1.0, e[3] if len(e) > 3 else None, directed)
    return g


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def found(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(params=[LOCAL, SPREAD], ids=["local", "spread"])
def limit(request):
    return request.param


def test_edges(spark):
    g = GraphStore(spark)
    g.add_edge(1, 2, "friend")
    g.add_edge(3, 3)
    g.add_weighted_edge(1, 2, 5.0, "friend", directed=True)
    g.add_edge(1, 2)
    assert sorted(map(tuple, g.edges().collect()), key=str) == sorted([(1, 2, "friend", 5.0), (2, 1, "friend", 1.0), (3, 3, None, 1.0), (1, 2, None, 1.0), (2, 1, None, 1.0)], key=str)
    g.remove_edge(1, 2, "friend", directed=True)
    assert found(g.neighbors(1)) == [2] and found(g.neighbors(1, "friend")) == [] and found(g.neighbors(2, "friend")) == [1]
    g.remove_edge(1, 2)
    assert found(g.neighbors(1)) == [] and found(g.neighbors(2)) == [1]
    g.add_edges(spark.createDataFrame([(7, 8, "x", 2.0), (7, 8, "x", 3.0), (9, 1, None, 1.0)], "src int, dst int, label string, weight double"))
    assert sorted(tuple(r) for r in g.edges().filter("src = 7").collect()) == [(7, 8, "x", 3.0)]
    g.remove_node(1)
    assert sorted((r["src"], r["dst"]) for r in g.edges().collect()) == [(3, 3), (7, 8)]
    g.remove_nodes(spark.range(8, 9))
    assert [(r["src"], r["dst"]) for r in g.edges().collect()] == [(3, 3)]


def test_steps(spark, limit):
    chain = graph(spark, limit, [(i, i + 1) for i in range(6)], directed=False)
    assert as_dict(chain.bfs(0)) == {i: i for i in range(7)}
    assert as_dict(chain.bfs(3, max_depth=1)) == {3: 0, 2: 1, 4: 1} and as_dict(chain.bfs(3, max_depth=0)) == {3: 0}
    assert as_dict(chain.bfs(99)) == {99: 0}
    assert chain.shortest_path(0, 4) == [0, 1, 2, 3, 4] and chain.shortest_path(2, 2) == [2] and chain.shortest_path(0, 99) is None
    labels = graph(spark, limit, [(1, 2, 1.0, "friend"), (1, 3, 1.0, "block"), (2, 3, 1.0, "friend")])
    assert as_dict(labels.bfs(1, label="friend")) == {1: 0, 2: 1, 3: 2} and labels.shortest_path(1, 3, "friend") == [1, 2, 3] and labels.shortest_path(3, 1) is None
    tied = graph(spark, limit, [(0, 5), (0, 2), (5, 9), (2, 9)])
    assert tied.shortest_path(0, 9) == [0, 2, 9]


def test_weights(spark, limit):
    g = graph(spark, limit, [(0, 1, 1.5), (1, 2, 2.5), (0, 3, 10.0), (2, 3, 1.0), (3, 4, -1.0), (3, 5, math.nan), (5, 6, 1.0), (3, 7, 0.0), (7, 3, 0.0), (7, 8, 2.0)])
    assert as_dict(g.dijkstra(0)) == {0: 0.0, 1: 1.5, 2: 4.0, 3: 5.0, 7: 5.0, 8: 7.0, 5: math.inf} | ({6: math.inf} if 6 in as_dict(g.dijkstra(0)) else {})
    assert g.shortest_path_weighted(0, 3) == ([0, 1, 2, 3], 5.0) and g.shortest_path_weighted(0, 8) == ([0, 1, 2, 3, 7, 8], 7.0)
    assert g.shortest_path_weighted(0, 4) is None and g.shortest_path_weighted(4, 4) == ([4], 0.0) and as_dict(g.dijkstra(42)) == {42: 0.0}
    labels = graph(spark, limit, [(0, 1, 1.0, "a"), (0, 1, 5.0, "b"), (1, 2, 1.0, "b")])
    assert as_dict(labels.dijkstra(0)) == {0: 0.0, 1: 1.0, 2: 2.0} and as_dict(labels.dijkstra(0, "b")) == {0: 0.0, 1: 5.0, 2: 6.0}


def test_pagerank(spark, limit):
    near = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-11 for k in want)
    rounds = 30 if limit == LOCAL else 12
    line = as_dict(graph(spark, limit, [(0, 1), (1, 2)], directed=False).pagerank(0.85, rounds))
    assert abs(sum(line.values()) - 1) < 1e-12
    if limit == LOCAL:
        assert near(line, {0: 0.257341094203, 1: 0.485317811594, 2: 0.257341094203})
        assert near(as_dict(graph(spark, limit, [(0, 1), (2, 0)]).pagerank(0.85, 30)), {0: 0.341171046611, 1: 0.474412171534, 2: 0.184416781855})
    assert as_dict(graph(spark, limit, [(0, 1), (2, 0)]).pagerank(0.85, 0)) == {0: 1 / 3, 1: 1 / 3, 2: 1 / 3}
    assert as_dict(graph(spark, limit).pagerank()) == {}


def test_random_graphs_agree(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(25), rnd.randrange(25), float(rnd.randint(0, 9)), rnd.choice(["a", "b", None])) for _ in range(60)]
    here, there = graph(spark, LOCAL, edges), graph(spark, SPREAD, edges)
    assert as_dict(here.bfs(1)) == as_dict(there.bfs(1)) and as_dict(here.dijkstra(1)) == as_dict(there.dijkstra(1))
    a, b = as_dict(here.pagerank(0.85, 7)), as_dict(there.pagerank(0.85, 7))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    for t in (5, 12, 20):
        assert here.shortest_path(1, t) == there.shortest_path(1, t)
        x, y = here.shortest_path_weighted(1, t), there.shortest_path_weighted(1, t)
        assert (x is None) == (y is None) and (x is None or x[1] == y[1])
