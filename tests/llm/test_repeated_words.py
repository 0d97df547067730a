from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import sentence

import sievelake.llm.suffix_dedup as m
from sievelake.llm.common import flat

#: One word, or one character of a script without spaces.
OWN = "\\u2e80-\\u312f\\u3190-\\ua4cf\\uf900-\\ufaff\\uff66-\\uff9d\\U00020000-\\U0003ffff"
UNITS = re.compile(f"[{OWN}]|[^\\x20\\x09-\\x0d{OWN}]+")


def without_repeats(texts: list[str], n: int) -> list[str]:
    """Each text without the words that a string of n words covers which begins in two places, and what is between them."""
    found = [list(UNITS.finditer(t)) for t in texts]
    often = Counter(tuple(u.group() for u in us[i : i + n]) for us in found for i in range(len(us) - n + 1))
    out = []
    for t, us in zip(texts, found, strict=True):
        hit = [False] * len(us)
        for i in range(len(us) - n + 1):
            if often[tuple(u.group() for u in us[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        kept, at, i = [], 0, 0
        while i < len(us):
            j = i
            while j < len(us) and hit[j]:
                j += 1
            if j > i:
                kept.append(t[at : us[i].start()])
                at = us[j - 1].end()
            i = max(j, i + 1)
        out.append("".join(kept) + t[at:])
    return out


def made(seed: int) -> list[str]:
    rnd = random.Random(seed)
    words = ["a", "b", "c", "de", "é", "漢", "字テ", "x漢y", "ß𠀀", "한국", "…", "z\x85w"]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(3, 14))] for _ in range(4)]
    texts = ["", " ", "漢", "a"]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += rnd.choice(passages) if rnd.random() < 0.5 else ["".join(rnd.choices("pqrst漢", k=4)) for _ in range(rnd.randint(0, 8))]
        texts.append("".join(p + rnd.choice([" ", "\n", "  ", " \t"]) for p in parts))
    return texts


@pytest.mark.parametrize("seed", range(10))
def test_units(seed):
    texts = made(seed)
    data, offsets = flat(pa.array(texts))
    starts, ends, rows = m.unit_spans(data, offsets)
    got = [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, rows, strict=True)]
    assert got == [(k, u.group()) for k, t in enumerate(texts) for u in UNITS.finditer(t)]
    codes, at = m.word_codes(data, offsets)
    assert np.diff(at).tolist() == [m.UNIT * len(UNITS.findall(t)) for t in texts]
    assert codes.max() < 255 and all((codes >= 0x80) == (np.arange(len(codes)) % m.UNIT == 0))


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("words", [1, 5, 12])
def test_repeats_of_words(spark, monkeypatch, words, hot):
    if hot:
        monkeypatch.setattr(m, "HOT", 1)
        monkeypatch.setattr("sievelake.llm.common.LIGHT_ROWS", 0)
        monkeypatch.setattr("sievelake.llm.common.HEAVY", 1000)
        monkeypatch.setattr(m, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(m, "SEEN", 3)
        monkeypatch.setattr(m, "SEGMENT", 500)
    texts = made(7)
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    got = m.cut_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").repartition(3), words=words)
    want = without_repeats(texts, words)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {i: (t, len(t)) for i, t in enumerate(want)}


def test_any_passage_of_so_many_words_goes_and_no_other(spark):
    rnd = random.Random(2)
    short, fewer = " ".join(rnd.choices("abcdef", k=51)), " ".join(f"{w}nessandmore" for w in sentence(rnd, 50).split())
    texts = [f"{sentence(rnd, 30)} {p} {sentence(rnd, 30)}" for p in (short, short.replace(" ", "\n"), fewer, fewer)]
    got = [r["text"] for r in m.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words=51).orderBy("doc_id").collect()]
    assert len(short) == 101 and len(fewer) > 600
    assert got == [texts[0].replace(short, ""), texts[1].replace(short.replace(" ", "\n"), ""), texts[2], texts[3]]


def test_special_cases(docs, rows, empty):
    got = m.cut_repeats(docs, words=20)
    assert got.schema == docs.schema and m.cut_repeats(empty, words=20).count() == 0
    want = Counter((r[0], None if r[1] is None else t, r[2]) for r, t in zip(rows, without_repeats([r[1] or "" for r in rows], 20), strict=True))
    assert Counter(tuple(r)[:3] for r in got.collect()) == want
