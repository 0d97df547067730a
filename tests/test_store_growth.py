"""A store of many changes, and access paths that outlive them."""

from __future__ import annotations

import threading

import pytest

import sievelake.store as m
from sievelake import shared
from sievelake.store import ID, Store


def ids(df):
    return sorted(r[ID] for r in df.collect())


def test_parts_are_written_together(spark, monkeypatch):
    monkeypatch.setattr(m, "MERGE", 3)
    s = Store(spark)
    for k in range(10):
        s.insert_frame(spark.range(2).selectExpr(f"id + {10 * k} AS n"))
    assert len(s._parts) == 2 and s._tiers == [2, 0]
    assert ids(s.find().execute(with_id=True)) == list(range(20)) and s.get(19) == {"n": 91}
    for k in range(7):
        s.delete_many(spark.range(k, k + 1))
    assert len(s._gone_frames) < 3 and ids(s.find().execute(with_id=True)) == list(range(7, 20))
    s.insert({"n": "text"})
    s.insert({"n": 91})
    assert ids(s.find().equals("n", 91).execute(with_id=True)) == [19, 21] and ids(s.find().equals("n", "text").execute(with_id=True)) == [20]


def test_paths_outlive_changes(spark):
    s = Store(spark, 1 << 40)
    s.insert_many([{"city": c, "bio": f"likes {c} trains"} for c in ("NYC", "SF", "NYC")])
    asks = [s.find().equals("city", "NYC"), s.find().contains("bio", "nyc"), s.find().substring("bio", "yc tra"), s.find().fuzzy("bio", "likes nyc trains", 0.9)]
    assert [ids(a.execute(with_id=True)) for a in asks] == [[0, 2]] * 4
    before = {k: p.frame for k, p in s.paths.live.items()}
    assert {k[0] for k in before} == {"hash", "words", "trigrams"}
    s.insert({"city": "NYC", "bio": "likes NYC trains", "more": 1})
    s.insert_frame(spark.createDataFrame([("NYC", "likes nyc trains")], "city string, bio string"))
    s.delete(0)
    assert [ids(a.execute(with_id=True)) for a in asks] == [[2, 3, 4]] * 4
    assert {k: p.frame for k, p in s.paths.live.items()} == before
    s.rebuild_sketches()  # writes the parts anew
    assert [ids(a.execute(with_id=True)) for a in asks] == [[2, 3, 4]] * 4
    assert all(p.frame is not before.get(k) for k, p in s.paths.live.items())


def test_a_refusal_is_remembered(spark, monkeypatch):
    import sievelake.plans.paths as paths

    s = Store.from_df(spark.range(3000).selectExpr("id", "id % 7 AS k"), "id", memory_budget=10)
    asked = []
    monkeypatch.setattr(paths, "_estimate", lambda *a: asked.append(1) or 1 << 30)
    for _ in range(3):
        assert s.find().equals("k", 3).execute().count() == 429
    assert len(asked) == 1
    s.set_memory_budget(20)
    s.find().equals("k", 3).execute()
    assert len(asked) == 2


def test_queries_go_on_while_a_path_is_built(spark, monkeypatch):
    import sievelake.plans.paths as paths

    s = Store.from_df(spark.range(100).selectExpr("id", "id % 7 AS k"), "id", memory_budget=1 << 40)
    held, go, build = threading.Event(), threading.Event(), paths._built

    def slow(*a):
        held.set()
        assert go.wait(60)
        return build(*a)

    monkeypatch.setattr(paths, "_built", slow)
    first = threading.Thread(target=lambda: s.find().equals("k", 3).execute())
    first.start()
    assert held.wait(60)
    assert s.find().equals("k", 3).execute().count() == 14 and s.index_inventory() == []
    go.set()
    first.join()
    assert [k[:2] for k in s.index_inventory()] == [("hash", "k")]


def test_a_common_value_is_spread(spark):
    s = Store.from_df(spark.range(20_000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('v', id)) AS v"), "id", memory_budget=1 << 40)
    s.find().equals("v", "hot").execute()
    s.find().contains("v", "hot").execute()
    for path in s.paths.live.values():
        sizes = [n for n in path.frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) > 1 and max(sizes) < 9000


def test_sketch_sizes(spark):
    s = Store(spark)
    s.insert_many([{"v": f"x{i}"} for i in range(40)])
    s.size_sketches(bits=64, hashes=1, rows=2, width=16)
    assert all(s.maybe_contains("v", f"x{i}") and s.estimate_count("v", f"x{i}") >= 1 for i in range(40))
    assert sum(s.maybe_contains("v", f"y{i}") for i in range(200)) > 20  # far too few bits
    with pytest.raises(ValueError):
        s.size_sketches(bits=0)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
