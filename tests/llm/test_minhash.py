from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import sievelake.llm.minhash as m
from sievelake.llm.common import flat
from sievelake.llm.components import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_shingles_and_shared_counts():
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(["a", "B", "b", " ", "\n", "é", "cc "], k=rnd.randint(0, 40))) for _ in range(600)] + ["", "a", "a b", " "]
    h, at = m.shingle_sets(*flat(pa.array(texts)), 3)
    sets = [shingles(t, 3) for t in texts]
    assert np.diff(at).tolist() == list(map(len, sets))
    keys = [tuple(x) for x in m.class_keys(h, at).tolist()]
    assert len(set(keys)) == len(set(sets)) and len(set(zip(keys, sets, strict=True))) == len(set(sets))
    g = m.shared_counts(h[: at[100]], at[:101])
    assert all(g[i, j] == len(sets[i] & sets[j]) for i in range(100) for j in range(100) if i != j)


def test_odd_sketches_tell_high_similarities():
    rnd = random.Random(5)
    base = [str(rnd.random()) for _ in range(400)]
    texts = [" ".join(base)] + [" ".join(w if rnd.random() > p else w + "x" for w in base) for p in (0.0, 0.01, 0.02, 0.03) for _ in range(10)]
    h, at = m.shingle_sets(*flat(pa.array(texts)), 3)
    sketch = m.odd_sketches(m.minhash_samples(h, at))
    sets = [shingles(t, 3) for t in texts]
    for i in range(len(texts)):
        true = len(sets[0] & sets[i]) / len(sets[0] | sets[i])
        differing = int(np.bitwise_count(sketch[0] ^ sketch[i]).sum())
        assert abs(float(m.similarity(differing)) - true) < 0.15
        assert true < 0.8 or differing <= m.MOST_DIFFERING


def test_spanning_forest():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert len(m.spanning_forest(linked)) == 3


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed, monkeypatch):
    if seed == 2:  # heavy nodes
        monkeypatch.setattr("sievelake.llm.common.LIGHT_ROWS", 0)
        monkeypatch.setattr("sievelake.llm.common.HEAVY", 20)
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 301 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("k,percent,blocks", [(3, 85, False), (5, 80, True)])
def test_matches_brute_force(docs, rows, k, percent, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(m, "BUCKET_BLOCK", 3)
        monkeypatch.setattr(m, "CLUSTER_BLOCK", 2)
        monkeypatch.setattr(m, "PAIR_SIZES", 2)
        monkeypatch.setattr("sievelake.llm.common.LIGHT_ROWS", 0)
        monkeypatch.setattr("sievelake.llm.common.HEAVY", 1000)
    sets, roots = brute(rows, k, percent)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    want = Counter((r[0], len(s), least[root] if s else r[0], (least[root] if s else r[0]) == r[0]) for r, s, root in zip(rows, sets, roots, strict=True))
    assert Counter(map(tuple, m.near_duplicates(docs, k, percent).collect())) == want


def test_keep_one(docs, rows, empty):
    got = m.keep_one(docs)
    assert got.schema == docs.schema
    sets, roots = brute(rows, 5, 80)
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    where = {}
    for r, s, root in zip(rows, sets, roots, strict=True):
        if s:
            where.setdefault(root, set()).add((r[0], r[1]))
        else:
            assert kept[r[0], r[1]] == Counter((x[0], x[1]) for x in rows)[r[0], r[1]]
    for group in where.values():
        (one,) = [x for x in group if kept[x]]
        assert one[0] == min((i for i, _ in group if i is not None), default=None)
    assert m.keep_one(empty).count() == 0 and m.near_duplicates(empty).count() == 0


def test_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(300):
        words = list(base)
        for _ in range(rnd.randint(1, 8)):
            words[rnd.randrange(150)] = f"y{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    sets, roots = brute(rows, 3, 85)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, i), i)
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == {i: least[root] for (i, _), root in zip(rows, roots, strict=True)}
