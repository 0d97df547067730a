from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import sievelake.llm.suffix_dedup as m
from sievelake.llm.common import flat


@pytest.mark.parametrize("seed", range(40))
def test_repeated_windows(seed):
    rnd = random.Random(seed)
    size, letters = rnd.choice([1, 2, 5, 9, 24, 30]), rnd.choice(["ab", "abc", "abcdefgh", "a", "éa"])
    contexts = list({"".join(rnd.choices(letters, k=rnd.randint(size, size + 30))).encode() for _ in range(rnd.randint(1, 40))})
    counts = np.array([rnd.choice([1, 1, 1, 2]) for _ in contexts])
    often = Counter()
    for c, n in zip(contexts, counts, strict=True):
        for i in range(len(c) - size + 1):
            often[c[i : i + size]] += n
    want = {(j, i) for j, c in enumerate(contexts) for i in range(len(c) - size + 1) if often[c[i : i + size]] > 1}
    assert {(int(a), int(b) + k) for a, b, n in zip(*m.repeated_windows(contexts, counts, size), strict=True) for k in range(n)} == want


def test_two_stage_order_is_the_suffix_order():
    rnd = random.Random(1)
    for _ in range(60):
        t = np.array([rnd.randint(1, 4) for _ in range(200)] + [0], np.uint8)
        raw = t.tobytes()
        assert m.two_stage_order(t, np.ones(len(t), bool), 201).tolist() == sorted(range(201), key=lambda i: raw[i:])


def test_every_window_has_one_anchor(monkeypatch):
    monkeypatch.setattr(m, "GRAM", 8)
    for segment in (1 << 23, 50):
        monkeypatch.setattr(m, "SEGMENT", segment)
        rnd = random.Random(3)
        texts = ["".join(rnd.choices("abc", k=rnd.randint(0, 100))) for _ in range(60)]
        row, h, start, n, lead = m.anchors(*flat(pa.array(texts)), 40)
        runs = [(int(r), int(s) + k, int(x)) for r, x, s, c in zip(row, h, start, n, strict=True) for k in range(c)]
        assert Counter(x[:2] for x in runs) == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 39))
        by = {}
        for r, p, x in runs:
            by.setdefault(texts[r][p : p + 40], set()).add(x)
        assert all(len(v) == 1 for v in by.values())
        grams = {}
        for r, s, d, x in zip(row, start, lead, h, strict=True):
            grams.setdefault(int(x), set()).add(texts[r][s + d : s + d + 8])
        assert all(len(v) == 1 for v in grams.values())


def spans_of(texts, size):
    often = Counter(b[i : i + size] for b in texts for i in range(len(b) - size + 1))
    for b in texts:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if often[b[i : i + size]] > 1:
                hit[i : i + size] = True
        yield hit


@pytest.mark.parametrize("hot", [False, True])
def test_matches_brute_force(docs, rows, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(m, "HOT", 1)
        monkeypatch.setattr("sievelake.llm.common.LIGHT_ROWS", 0)
        monkeypatch.setattr("sievelake.llm.common.HEAVY", 1000)
        monkeypatch.setattr(m, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(m, "SEEN", 3)
    bodies = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, b, hit in zip(rows, bodies, spans_of(bodies, 120), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        want[r[0], len(b), int(hit.sum()), int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(hit) else 0, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, m.repeat_digests(docs, 120).collect())) == want


def test_cut_repeats(docs, rows, empty):
    got = m.cut_repeats(docs, 120)
    assert got.schema == docs.schema
    bodies = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, b, hit in zip(rows, bodies, spans_of(bodies, 120), strict=True):
        text = bytes(np.frombuffer(b, np.uint8)[~hit]).decode(errors="ignore")
        want[(r[0], None if r[1] is None else text, r[2], r[3], len(text) if hit.any() else r[4], "x")] += 1
    assert Counter((*tuple(r)[:5], r["key"]) for r in got.collect()) == want
    assert m.cut_repeats(empty).count() == 0 and m.repeat_digests(empty).count() == 0
