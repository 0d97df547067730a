"""Tries over texts' own bytes: branches, spilled subtrees, and which of equal rows stays."""

from __future__ import annotations

import random

import pytest

import sievelake.llm.exact_dedup as m


def test_nodes_branch_by_the_texts_bytes():
    owners = m.Owners()
    for i, text in enumerate([b"romane", b"romanu", b"rubens", b"romane"]):
        owners.add(6, b"\x07 a digest", text, i, 1)
    (trie,) = owners.tries.values()
    (child,) = trie.root[1].values()
    assert child[0] == b"r" and {c[0] for c in child[1].values()} == {b"oman", b"ubens"}
    assert {t: e[:2] for t, e in trie.items()} == {b"romane": [3, 2], b"romanu": [1, 1], b"rubens": [2, 1]}


@pytest.mark.parametrize("seed", range(20))
def test_agreement(seed):
    rnd = random.Random(seed)
    label = bytes(rnd.choices(b"ab", k=rnd.randint(1, 400)))
    for n in (0, 1, len(label) // 2, len(label) - 1):
        other = label[:n] + bytes([label[n] ^ 3]) + bytes(rnd.choices(b"ab", k=rnd.choice([0, 5, 500])))
        assert m.agreement(b"xy" + other, 2, label) == n
    assert m.agreement(b"xy" + label[: len(label) // 2], 2, label) == len(label) // 2


def test_spilled_subtrees_hold_what_was_inserted(monkeypatch):
    monkeypatch.setattr(m, "TRIE_BYTES", 3000)
    rnd = random.Random(3)
    owners, want, got = m.Owners(), {}, {}

    def count(rows):
        for length, digest, text, top, n, _ in rows:
            assert length == len(text) and digest[1:] == text[:3]
            old = got.get(text, (-1, 0))
            got[text] = max(top, old[0]), n + old[1]

    for i in range(2000):
        text = bytes(rnd.choices(b"abc", k=rnd.choice([0, 2, 5, 9])))
        old = want.get(text, (-1, 0))
        want[text] = max(i, old[0]), old[1] + 1
        owners.add(len(text), bytes([len(text) % 2]) + text[:3], text, i, 1)
        if owners.held > m.TRIE_BYTES:
            count(owners.spill())
            assert owners.held <= m.TRIE_BYTES // 2 and owners.held == sum(t.held for t in owners.tries.values())
    count(owners.take_all())
    assert got == want and owners.held == 0


def test_of_equal_rows_the_first_in_written_order_stays(spark):
    rows = [(7, "same", x, n) for x, n in (("c", 1), ("a", 2), ("b", 3))] + [(3, "same", "a", 0), (None, "same", "a", 0), (9, None, "n", 1), (9, "", "m", 1)]
    for parts in (1, 2, 5):
        d = spark.createDataFrame(rows, "Doc_ID int, Text string, `x.y` string, n int").repartition(parts)
        got = m.keep_distinct(d)
        assert got.schema.names == d.schema.names and got.dtypes == d.dtypes
        assert sorted(map(tuple, got.collect())) == [(7, "same", "a", 2), (9, "", "m", 1)]


def test_columns_of_all_kinds_come_back(spark):
    import datetime
    from decimal import Decimal

    d = spark.createDataFrame(
        [(1, "a", Decimal("1.50"), datetime.date(2020, 1, 2), datetime.datetime(2021, 5, 6, 7, 8, 9), [1, None], {"k": 1.5}, (1, "z"), bytearray(b"\x00\xff"), None)] * 2,
        "doc_id bigint, text string, d decimal(10,2), day date, at timestamp, l array<int>, m map<string,double>, s struct<p:int,q:string>, b binary, none string",
    )
    (row,) = m.keep_distinct(d).collect()
    assert row == d.first()
    assert m.keep_distinct(d.limit(0)).count() == 0
