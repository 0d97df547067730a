from __future__ import annotations

from sievelake.operators import graph as m


def joined(spark, edges):
    return m.GraphStore(spark, spark.createDataFrame([(s, d, None, float(w)) for s, d, w in edges], m.EDGES), local_edges=0)


def test_walks_have_no_last_round(spark, monkeypatch):
    monkeypatch.setattr(m, "ROUNDS", 3, raising=False)  # a bound that there was once
    chain = joined(spark, [(i, i + 1, 1) for i in range(6)])
    assert {r["id"]: r["depth"] for r in chain.bfs(0).collect()} == {i: i for i in range(7)}
    assert chain.shortest_path(0, 6) == list(range(7))
    assert chain.shortest_path_weighted(0, 6) == (list(range(7)), 6.0)


def test_no_node_twice_over_edges_of_no_weight(spark):
    edges = [(9, 5, 1), (2, 5, 0), (5, 2, 0), (2, 3, 0), (3, 2, 0)]
    assert joined(spark, edges).shortest_path_weighted(9, 5) == ([9, 5], 1.0)
    assert joined(spark, edges).shortest_path_weighted(9, 3) == ([9, 5, 2, 3], 1.0)
