"""Predicates, boolean nodes and ordering on small stores, and random trees against a plain evaluator."""

from __future__ import annotations

import math
import random
import re

import pytest

from sievelake.plans.builder import QueryBuilder
from sievelake.plans.nodes import And, Not, Or, Predicate
from sievelake.store import ID, Store

Q = QueryBuilder()


def store(spark, records, budget=0):
    out = Store(spark, budget)
    out.insert_many(records)
    return out


def ids(builder):
    return sorted(r[ID] for r in builder.execute(with_id=True).collect())


@pytest.fixture(scope="module")
def people(spark):
    rows = [("Alice", 30, "NYC", 88), ("Anya", 25, "SF", 92), ("Andre", 41, "NYC", 70), ("Bea", 30, "SF", 85), ("Ben", 22, "LA", 60)]
    return store(spark, [dict(zip(("name", "age", "city", "score"), r, strict=True)) for r in rows])


@pytest.mark.parametrize(
    ("ask", "want"),
    [
        (lambda q: q.equals("city", "NYC"), [0, 2]),
        (lambda q: q.equals("city", "nyc"), []),
        (lambda q: q.equals("age", 30.0), [0, 3]),
        (lambda q: q.equals("age", 30.5), []),
        (lambda q: q.equals("age", "30"), []),
        (lambda q: q.equals("age", math.nan), []),
        (lambda q: q.equals("ghost", 1), []),
        (lambda q: q.range("age", 25, 30), [0, 1, 3]),
        (lambda q: q.range("age", 24.5, 30.0), [0, 1, 3]),
        (lambda q: q.range("age", 30, 25), []),
        (lambda q: q.range("age", -math.inf, math.inf), [0, 1, 2, 3, 4]),
        (lambda q: q.range("age", 1, math.nan), []),
        (lambda q: q.range("age", "a", "z"), []),
        (lambda q: q.range("name", "An", "B"), [1, 2]),
        (lambda q: q.prefix("name", "An"), [1, 2]),
        (lambda q: q.prefix("name", ""), [0, 1, 2, 3, 4]),
        (lambda q: q.prefix("age", "3"), []),
        (lambda q: q.range("age", 20, 35).prefix("name", "A").equals("city", "NYC"), [0]),
        (lambda q: q.any_of([Q.equals("city", "LA"), Q.range("age", 40, 50)]), [2, 4]),
        (lambda q: q.any_of([]), []),
        (lambda q: q.any_of([Q]), [0, 1, 2, 3, 4]),
        (lambda q: q.exclude(Q.equals("city", "NYC")), [1, 3, 4]),
        (lambda q: q.exclude(None), [0, 1, 2, 3, 4]),
        (lambda q: q.exclude(Q.equals("ghost", 1)), [0, 1, 2, 3, 4]),
        (lambda q: q.exclude(Q.equals("age", "30")), [0, 1, 2, 3, 4]),
        (lambda q: q.exclude(Q.any_of([])), [0, 1, 2, 3, 4]),
        (lambda q: q.any_of([Q.equals("city", "NYC"), Q.equals("city", "SF")]).exclude(Q.range("score", 80, 90)), [1, 2]),
    ],
)
def test_people(people, ask, want):
    assert ids(ask(people.find())) == want


def test_order(spark):
    s = store(spark, [{"v": v} for v in (3, 1, 4, 1, 5, 9, 2, 6)] + [{"other": 99}])
    top = lambda *a: [r["v"] for r in s.find().top_k("v", *a).execute().collect()]
    assert top(3) == [9, 6, 5] and top(3, False) == [1, 1, 2] and top(0) == [] and len(top(100)) == 8
    for down in (True, False):
        tied = store(spark, [{"v": 7} for _ in range(6)])
        assert [r[ID] for r in tied.find().top_k("v", 3, down).execute(with_id=True).collect()] == [0, 1, 2]
    assert s.find().top_k("ghost", 3).execute().count() == 0
    assert [r["v"] for r in s.find().top_k("other", 1).top_k("v", 1, False).execute().collect()] == [1]
    assert s.find().top_k("v", 1).to_node() is None


def test_missing_attributes_stay_under_not(spark):
    s = store(spark, [{"name": "Al"}, {"age": 3}, {"name": "Bo", "age": 4}, {}])
    assert ids(s.find().exclude(Q.equals("name", "Al"))) == [1, 2, 3]
    assert ids(s.find().exclude(Q.prefix("name", "B").range("age", 1, 9))) == [0, 1, 3]
    assert ids(s.find().exclude(Q.exclude(Q.prefix("name", "A")))) == [0]
    assert ids(s.find().exclude(Q.near("name", 0, 0, 1))) == [0, 1, 2, 3]


def test_mixed_families(spark):
    s = store(spark, [{"x": 1}, {"x": "1"}, {"x": 1.5}, {"x": "abc"}, {"x": [1.0, 2.0]}, {}])
    assert ids(s.find().equals("x", 1)) == [0] and ids(s.find().equals("x", "1")) == [1]
    assert ids(s.find().range("x", 1, 2)) == [0, 2] and ids(s.find().range("x", "1", "b")) == [1, 3]
    assert ids(s.find().prefix("x", "")) == [1, 3] and ids(s.find().within_box("x", 0, 0, 3, 3)) == [4]
    assert ids(s.find().exclude(Q.equals("x", 1))) == [1, 2, 3, 4, 5]
    assert s.get(3) == {"x": "abc"} and s.get(5) == {}


def test_numbers_at_the_edge(spark):
    big = 2**53
    s = store(spark, [{"n": big}, {"n": big + 1}, {"n": -(2**63)}])
    assert ids(s.find().equals("n", big + 1)) == [1]
    assert ids(s.find().equals("n", float(big))) == [0, 1]  # compared as doubles
    assert ids(s.find().equals("n", 2**70)) == [] and ids(s.find().range("n", -(2**70), 2**70)) == [0, 1, 2] and ids(s.find().range("n", 2**70, 2**71)) == []
    f = store(spark, [{"f": 0.0}, {"f": -0.0}, {"f": math.nan}, {"f": math.inf}])
    assert ids(f.find().equals("f", 0)) == [0, 1] and ids(f.find().range("f", 0, math.inf)) == [0, 1, 3]
    assert ids(store(spark, [{"l": [1, 2]}, {"l": [1]}, {"l": []}]).find().equals("l", [1, 2])) == [0]
    v = store(spark, [{"l": [1, 2]}, {"l": ["a"]}, {"l": 3}, {"l": ["1", "2"]}])
    assert ids(v.find().equals("l", [1.0, 2])) == [0] and ids(v.find().equals("l", ["a"])) == [1] and ids(v.find().equals("l", [2])) == []


@pytest.mark.parametrize(
    ("word", "want"),
    [("cats", [0, 3]), ("CATS", [0, 3]), ("cat", [4]), ("dogs", [1, 4]), ("world", [5]), ("two words", []), ("", []), ("a-b", []), ("caf", [6]), ("café", [])],
)
def test_contains(spark, word, want):
    bios = ["loves cats", "loves dogs", "dog person all the way", "loves cats and long walks", "cat owner who also walks dogs", "hello, world! how are you?", "café"]
    assert ids(store(spark, [{"bio": b} for b in bios]).find().contains("bio", word)) == want


@pytest.mark.parametrize(
    ("target", "threshold", "want"),
    [("Alise", 0.4, [0]), ("Alise", 0.41, []), ("Alise", 0.25, [0, 1, 2]), ("alice", 1.0, [0]), ("bob", 0.0, [3]), ("bob", -1, [3]), ("bob", math.nan, []), ("", 1.0, [5]), ("", 0.01, [5])],
)
def test_fuzzy(spark, target, threshold, want):
    assert ids(store(spark, [{"name": n} for n in ("Alice", "Alicia", "Alyce", "Bob", "Charlie", "")]).find().fuzzy("name", target, threshold)) == want


@pytest.mark.parametrize(("part", "want"), [("cat", [0, 1, 3, 4]), ("CAT", [0, 1, 3, 4]), ("s c", [0]), ("a", [0, 1, 3, 4]), ("", [0, 1, 2, 3, 4, 5]), ("%", []), ("_", [])])
def test_substring(spark, part, want):
    bios = ["loves cats", "scattered notes", "dog pers.n", "concatenation", "CAT photos", "hello world"]
    assert ids(store(spark, [{"bio": b} for b in bios]).find().substring("bio", part)) == want


@pytest.mark.parametrize("kept", ["list", "struct", "pair"])
def test_points(spark, kept):
    xy = [(0.0, 0.0), (3.0, 4.0), (6.0, 8.0), (100.0, 100.0), (math.nan, 1.0)]
    if kept == "list":
        s = store(spark, [{"loc": list(p)} for p in xy] + [{"loc": [1.0]}, {"other": 1}])
    else:
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(xy)], "id bigint, x double, y double")
        s = Store.from_df(df, "id", {"loc": ("x", "y")}, 0) if kept == "pair" else Store.from_df(df.selectExpr("id", "struct(x, y) AS loc"), "id", memory_budget=0)
    near = lambda *a: ids(s.find().near("loc", *a))
    box = lambda *a: ids(s.find().within_box("loc", *a))
    assert near(0, 0, 5) == [0, 1] and near(0, 0, 4.999) == [0] and near(0, 0, 11) == [0, 1, 2]
    assert near(0, 0, -1) == [] and near(0, 0, math.nan) == [] and near(0, 0, math.inf) == [0, 1, 2, 3]
    assert box(0, 0, 3, 4) == [0, 1] and box(3, 4, 0, 0) == [] and box(math.nan, 0, 9, 9) == [] and box(-math.inf, -math.inf, math.inf, math.inf) == [0, 1, 2, 3]


# --- random trees ----------------------------------------------------------------------------------


def plain(row, node):
    if node is None:
        return True
    if isinstance(node, And):
        return all(plain(row, c) for c in node.children)
    if isinstance(node, Or):
        return any(plain(row, c) for c in node.children)
    if isinstance(node, Not):
        return node.child is None or not plain(row, node.child)
    assert isinstance(node, Predicate)
    v, a = row.get(node.attribute), node.args
    number = lambda x: isinstance(x, (int, float))
    text = isinstance(v, str)
    grams = lambda s: {f"  {s.lower()}  "[i : i + 3] for i in range(len(s) + 2)}
    match node.kind:
        case "equals":
            return v is not None and (number(v) == number(a[0])) and v == a[0]
        case "range":
            return v is not None and number(v) == number(a[0]) and a[0] <= v <= a[1]
        case "prefix":
            return text and v.startswith(a[0])
        case "contains":
            return text and a[0].lower() in [t.lower() for t in re.findall("[a-zA-Z0-9]+", v)]
        case "substring":
            return text and a[0].lower() in v.lower()
        case "fuzzy":
            if not text:
                return False
            x, y = grams(v), grams(a[0])
            return bool(x & y) and len(x & y) / len(x | y) >= a[1]
    raise AssertionError


def tree(rnd, depth=3):
    if depth == 0 or rnd.random() < 0.3:
        name, value = rnd.choice(["name", "note"]), rnd.choice(["ab", "b", "Abc", "c d", ""])
        return rnd.choice(
            [
                Q.equals("age", rnd.choice([1, 2.0, "1", 7])), Q.range("age", rnd.choice([0, 1.5]), rnd.choice([2, 3.5])), Q.equals(name, value), Q.prefix(name, value),
                Q.contains(name, value), Q.substring(name, value), Q.fuzzy(name, value, rnd.choice([0.0, 0.3, 0.9])), Q.range(name, "a", "b"), Q.equals("ghost", 1),
            ]
        )
    parts = [tree(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    kind = rnd.random()
    if kind < 0.35:
        return Q.any_of(parts)
    if kind < 0.65:
        return Q.exclude(parts[0] if parts else None)
    out = Q
    for p in parts:
        node = p.to_node()
        out = out.any_of([node]) if node is not None else out
    return out


def test_random_trees(spark):
    rnd = random.Random(17)
    records = []
    for _ in range(60):
        full = {"age": rnd.choice([0, 1, 2, 3]), "name": "".join(rnd.choices("abcABC d", k=rnd.randint(0, 6))), "note": rnd.choice(["ab", "c d", "abc ab"])}
        records.append({k: v for k, v in full.items() if rnd.random() < 0.8})
    off, on = store(spark, records), store(spark, records, 1 << 40)
    for _ in range(45):
        q = tree(rnd).query()
        want = [i for i, r in enumerate(records) if plain(r, q.where)]
        assert sorted(r[ID] for r in off.execute(q, with_id=True).collect()) == want, q
        if rnd.random() < 0.3:  # by way of access paths
            assert sorted(r[ID] for r in on.execute(q, with_id=True).collect()) == want, q
    assert on.index_inventory() and not off.index_inventory()


# --- plans -------------------------------------------------------------------------------------------


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 AS int) AS k", "cast(id AS double) AS v", "concat('n', id) AS name").write.parquet(str(tmp_path / "t"))
    s = Store.from_df(spark.read.parquet(str(tmp_path / "t")), "id", memory_budget=0)
    plan = lambda b: s.explain(b.query())
    assert "EqualTo(k,3)" in plan(s.find().equals("k", 3.0)) and "GreaterThanOrEqual(v,1.0)" in plan(s.find().range("v", 1, 2))
    assert "StringStartsWith(name,n1)" in plan(s.find().prefix("name", "n1")) and "Or(EqualTo(k,1)" in plan(s.find().any_of([Q.equals("k", 1), Q.equals("k", 2)]))
    assert "EqualNullSafe(k,1)" in plan(s.find().exclude(Q.equals("k", 1)))
    assert "TakeOrderedAndProject" in plan(s.find().top_k("v", 3)) and "Python" not in plan(s.find().fuzzy("name", "n10", 0.5).contains("name", "n1"))
    narrow = s.find().equals("k", 3).execute().select("name")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<k:int,name:string>", narrow)
