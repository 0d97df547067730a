"""The store: ids, changes, sketches, access paths, snapshots, streams."""

from __future__ import annotations

import json
import random
import threading

import pytest

from sievelake.operators.sketch import BloomSketch, CountMinSketch, bloom_positions_of, count_columns_of
from sievelake.plans.builder import QueryBuilder
from sievelake.store import ID, Store
from sievelake.streaming.ingest import ingest

Q = QueryBuilder()


def ids(df):
    return sorted(r[ID] for r in df.collect())


def test_ids_and_lookups(spark):
    s = Store(spark)
    assert s.is_empty() and len(s) == 0 and s.get(0) is None
    assert [s.insert({"n": i}) for i in range(3)] == [0, 1, 2]
    assert s.delete(2) and not s.delete(2) and not s.delete(77)
    assert s.insert({}) == 3 and s.get(3) == {} and s.get(1) == {"n": 1} and s.get(2) is None
    assert len(s) == 3
    assert s.insert_frame(spark.range(5).selectExpr("id AS n").repartition(3)) == range(4, 9)
    assert ids(s.find().execute(with_id=True)) == [0, 1, 3, 4, 5, 6, 7, 8] and s.insert({"n": 9}) == 9
    s.delete_many(spark.range(4, 7))
    assert ids(s.find().execute(with_id=True)) == [0, 1, 3, 7, 8, 9]
    assert "_id" not in s.find().execute().columns
    with pytest.raises(TypeError):
        s.insert({"x": object()})


def test_from_df_continues_ids(spark):
    s = Store.from_df(spark.createDataFrame([(5, "a"), (9, "b")], "k int, v string"), "k")
    assert s.insert({"v": "c"}) == 10 and s.get(9) == {"k": 9, "v": "b"}


def test_insert_after_a_query_is_seen(spark):
    s = Store(spark, 1 << 40)
    s.insert({"c": "x"})
    assert s.find().equals("c", "x").execute().count() == 1
    s.insert({"c": "x"})
    assert s.find().equals("c", "x").execute().count() == 2
    s.delete(0)
    assert ids(s.find().equals("c", "x").execute(with_id=True)) == [1]


def test_inserts_from_threads(spark):
    s = Store(spark)
    threads = [threading.Thread(target=lambda k=k: [s.insert({"t": k, "i": i}) for i in range(25)]) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ids(s.find().execute(with_id=True)) == list(range(100)) and s.find().equals("t", 2).execute().count() == 25


def test_sketch_positions():
    assert bloom_positions_of("NYC") == [13444, 11932, 12621, 10661, 13444]
    assert count_columns_of("NYC") == [902, 182, 147, 267, 941]
    assert bloom_positions_of(1) == bloom_positions_of(1.0) == bloom_positions_of("1")


def test_sketches(spark):
    s = Store(spark)
    for i in range(30):
        s.insert({"item": f"item-{i % 10}", "n": i % 3, "f": [1.0, 0.5, 1.25e20, 1.5e-7, -0.0, 12345678.9][i % 6]})
    assert all(s.maybe_contains("item", f"item-{i}") for i in range(10)) and not s.maybe_contains("item", "nope") and not s.maybe_contains("ghost", 1)
    assert s.estimate_count("item", "item-3") >= 3 and s.estimate_count("n", 1.0) >= 10 and s.estimate_count("ghost", 1) == 0
    for v in (1.0, 0.5, 1.25e20, 1.5e-7, -0.0, 12345678.9):
        assert s.maybe_contains("f", v) and s.estimate_count("f", v) >= 5, v
    before = s.estimate_count("item", "item-3")
    s.delete(3)
    assert s.estimate_count("item", "item-3") == before  # what was inserted counts
    s.rebuild_sketches()
    assert s.estimate_count("item", "item-3") == before - 1


def test_sketch_quality(spark):
    df = spark.range(200).selectExpr("concat('item-', id) AS item")
    bloom = BloomSketch.of(df, "item")
    assert all(bloom.maybe_contains(f"item-{i}") for i in range(200)) and sum(bloom.maybe_contains(f"other-{i}") for i in range(10_000)) < 200
    count = CountMinSketch.of(spark.range(50).selectExpr("explode(array_repeat(concat('item-', id), int(id) + 1)) AS item"), "item")
    assert all(count.estimate(f"item-{i}") >= i + 1 for i in range(50))
    small = BloomSketch.of(df, "item", bits=101, hashes=2)
    assert small.maybe_contains("item-5") and max(small.set_bits) < 101


def test_paths(spark):
    rnd = random.Random(3)
    s = Store(spark, 1 << 40)
    s.insert_many([{"city": rnd.choice(["NYC", "SF"]), "age": rnd.randrange(90), "name": f"n{i} blue", "loc": [rnd.random(), rnd.random()]} for i in range(120)])
    assert s.index_inventory() == []
    q = s.find().range("age", 10, 50).prefix("name", "n1").contains("name", "blue").substring("name", "2 b").near("loc", 0.5, 0.5, 0.6).equals("age", 20)
    rows = ids(q.execute(with_id=True))
    assert {k[:2] for k in s.index_inventory()} == {("sorted", "age"), ("prefix", "name"), ("words", "name"), ("trigrams", "name"), ("spatial", "loc")}
    s.find().equals("city", "SF").execute()
    assert ("hash", "city") in {k[:2] for k in s.index_inventory()}
    s.set_memory_budget(0)
    assert s.index_inventory() == [] and ids(q.execute(with_id=True)) == rows
    s.set_memory_budget(1)
    assert ids(q.execute(with_id=True)) == rows and s.index_inventory() == []


def test_large_paths_are_not_built(spark, tmp_path):
    spark.range(20_000).repartition(1).selectExpr("id", "id % 9 AS k", "uuid() AS u").write.parquet(str(tmp_path / "t"))
    s = Store.from_df(spark.read.parquet(str(tmp_path / "t")), "id", memory_budget=100_000)
    found = s.find().equals("k", 3).execute()
    assert found.count() == 2222 and s.index_inventory() == [] and "InMemoryTableScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_eviction_takes_the_least_used(spark):
    s = Store(spark, 1 << 40)
    s.insert_many([{"a": i, "b": i} for i in range(50)])
    for _ in range(30):
        s.find().range("a", 1, 2).execute()
    s.find().range("b", 1, 2).execute()
    sizes = {k[1]: k[2] for k in s.index_inventory()}
    s.set_memory_budget(sizes["a"])
    assert [k[1] for k in s.index_inventory()] == ["a"]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_snapshots(spark, tmp_path, format):
    s = Store(spark)
    s.insert_many([{"name": "Al", "age": 3, "f": 1.0, "loc": [1.0, 2.0]}, {"name": "Bo"}, {"x": 1}, {"x": "1"}, {}])
    s.delete(1)
    s.add_edge(0, 2, "friend")
    s.add_weighted_edge(0, 2, 2.5, None, directed=True)
    s.save(str(tmp_path / "snap"), format)
    t = Store.load(spark, str(tmp_path / "snap"), format=format)
    assert [t.get(i) for i in range(6)] == [s.get(i) for i in range(6)] == [{"name": "Al", "age": 3, "f": 1.0, "loc": [1.0, 2.0]}, None, {"x": 1}, {"x": "1"}, {}, None]
    assert sorted(map(str, t.graph.edges().collect())) == sorted(map(str, s.graph.edges().collect()))
    assert t.insert({"name": "Cy"}) == 5 and t.index_inventory() == []
    assert not t.maybe_contains("name", "Bo")


def test_foreign_json(spark, tmp_path):
    doc = {
        "version": 1, "next_id": 9,
        "records": [{"id": 4, "attrs": {"v": {"Float": 1.0}, "l": {"List": [{"Int": 1}, {"String": "a"}]}}}, {"id": 7, "attrs": {"v": {"Int": 2}}}, {"id": 4, "attrs": {"v": {"Float": 3.5}}}],
        "edges": [{"from": 4, "to": 7, "label": None}],
    }
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    s = Store.load(spark, str(tmp_path / "s.json"), format="json")
    assert s.get(4) == {"v": 3.5} and s.get(7) == {"v": 2.0} and s.insert({}) == 9
    assert [tuple(r) for r in s.graph.edges().collect()] == [(4, 7, None, 1.0)]
    empty = Store(spark)
    empty.save(str(tmp_path / "e.json"), "json")
    assert Store.load(spark, str(tmp_path / "e.json"), format="json").is_empty()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    s = Store(spark)
    s.insert({"n": -1})
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).selectExpr("id AS n").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("n bigint").parquet(str(source))
        ingest(stream, s, str(tmp_path / "check"), available_now=True).awaitTermination()
        assert len(s) == 1 + 10 * (k + 1)
    assert ids(s.find().execute(with_id=True)) == list(range(21))
