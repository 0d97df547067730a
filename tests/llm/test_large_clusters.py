"""Clusters beyond a block: what is found around hubs and what is left for pairs of blocks is all there is."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from test_minhash import brute

import sievelake.llm.minhash as m


def answers(rows, k, percent):
    sets, roots = brute(rows, k, percent)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    return Counter((r[0], least[root] if s else r[0]) for r, s, root in zip(rows, sets, roots, strict=True))


def copies(seed, n, edits, words=150):
    """Copies of one text with so many words changed: far ones are similar, but linked only through others."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rnd.choice(edits)):
            text[rnd.randrange(words)] = f"y{rnd.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed,edits", [(1, (1, 2, 3)), (2, (6, 9, 12)), (3, (0, 1, 14))])
def test_large_clusters_match_brute_force(spark, monkeypatch, seed, edits):
    monkeypatch.setattr(m, "CLUSTER_BLOCK", 20)
    monkeypatch.setattr(m, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(m, "BRIDGES", 2)
    texts = copies(seed, 110, edits) + copies(seed + 10, 40, edits) + copies(seed + 20, 3, (1,))
    rows = list(enumerate(texts + texts[:9]))
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 3, 85)
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == answers(rows, 3, 85)


def test_a_chain_is_one_component(spark, monkeypatch):
    """Each text is similar to the next one only."""
    monkeypatch.setattr(m, "CLUSTER_BLOCK", 8)
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(900)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 240])) for i in range(50)]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == answers(rows, 3, 85)


def test_one_block_needs_no_hubs(spark, monkeypatch):
    monkeypatch.setattr(m, "_around_hubs", lambda *a: pytest.fail("a cluster that fits into a task"))
    rows = list(enumerate(copies(5, 30, (1, 2))))
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)
    assert {r["component_id"] for r in got.collect()} == {0}
