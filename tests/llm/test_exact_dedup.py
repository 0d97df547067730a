from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import sievelake.llm.exact_dedup as m
from hypothesis import given, settings
from hypothesis import strategies as st


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_trie_holds_what_a_dict_holds(pairs):
    trie, want = m.PatriciaTrie(), {}
    for key, i in pairs:
        trie.insert(key, i, 1, None)
        top, n = want.get(key, (-1, 0))
        want[key] = (max(top, i), n + 1)
    assert {k: (t[0], t[1]) for k, t in trie.items()} == want


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i, n in Counter(ids).items():
            out += [(i, keep, len(ids), i == keep and k == 0, hashlib.sha256(text.encode()).hexdigest()) for k in range(n)]
    return Counter(out)


def test_matches_brute_force(docs, rows):
    assert Counter(map(tuple, m.exact_dedup(docs).collect())) == brute(rows)


def test_spills_and_levels_change_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(m, "TRIE_BYTES", 2000)
    monkeypatch.setattr(m, "likely_partitions", lambda _: 10**6)
    assert Counter(map(tuple, m.exact_dedup(docs).collect())) == brute(rows)


def test_smallest_can_stay(spark):
    d = spark.createDataFrame([(3, "a", 0), (1, "a", 0), (2, "b", 0)], "doc_id int, text string, n int")
    assert {(r["doc_id"], r["keep_id"]) for r in m.exact_dedup(d, smallest=True).collect()} == {(3, 1), (1, 1), (2, 2)}


def test_empty(empty):
    assert m.exact_dedup(empty).count() == 0
    assert m.keep_distinct(empty).count() == 0


def test_hot_group(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"text {rnd.random()}") for i in range(3000)]
    got = m.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    assert {tuple(r) for r in got.filter("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(2997, 1000)}
    assert got.filter("kept").count() == 2001


def test_keep_distinct_keeps_columns(docs, rows):
    got = m.keep_distinct(docs)
    assert got.schema == docs.schema
    kept = Counter((r["doc_id"], r["text"] or "") for r in got.collect())
    assert kept == Counter((i, t) for t, i in {(r[1] or ""): None for r in rows}.keys() and {t: max((r[0] for r in rows if (r[1] or "") == t and r[0] is not None), default=None) for t in {r[1] or "" for r in rows}}.items())
