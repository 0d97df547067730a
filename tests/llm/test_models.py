from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelake.llm import byte_cnn, doc_stats, language_id, quality_rules
from sievelake.llm.common import flat
from sievelake.llm.labelled import id_crc, quality_sample

WORD = r"[^\x20\x09-\x0D]+"


def brute_stats(text):
    words, seen, dup = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_stats(rows):
    rnd = random.Random(2)
    parts = ["a", "b", " ", "\n", "\n\n", "é", "\r\n", "#", "\t", "日 "]
    texts = [r[1] or "" for r in rows] + ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(1500)] + ["", "", " ", "\n"]
    for at in range(0, len(texts), 97):
        stats = doc_stats.base_stats(*flat(pa.array(texts[at : at + 97])))
        got = list(zip(*(stats[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        assert got == [brute_stats(t) for t in texts[at : at + 97]]


def test_forest_is_monotonic_and_learns():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3) ^ (rng.random(1500) < 0.05)).astype(int)
    forest = quality_rules.fit_forest(x[:1000], y[:1000], np.array([-1, 1, 0, 0]))
    assert ((forest.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.9
    probe = np.repeat(x[:50], 60, axis=0)
    for f, way in ((0, -1), (1, 1)):
        p = probe.copy()
        p[:, f] = np.tile(np.linspace(-0.1, 1.1, 60), 50)
        assert (np.diff(forest.score(p).reshape(50, 60), axis=1) * way >= -1e-12).all()
    # flattened walks agree with a plain walk
    for row, got in zip(x[:30], forest.score(x[:30]), strict=True):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality_rules.fit_forest(x, np.ones(1500, int), np.zeros(4)) is None


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of which symbol spam is labelled 0, and their labels."""
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rnd.choices(["ne", "ka", "li", "to", "re"], k=rnd.randint(1, 3))) for _ in range(rnd.randint(25, 90))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "$$$" * (rnd.random() < 0.6) for w in words) if bad else " ".join(words)))
        labels.append((i, int(not bad)))
    labels += [(None, 1), (3, None), (10_000, 1), (5, 7), labels[2], labels[2]]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_quality_rules(marked, docs, rows, empty):
    good, labels = marked
    got = quality_rules.quality_rules(good, labels).filter("NOT base_failed")
    assert got.filter((F.col("doc_id") % 4 == 0) & F.col("kept")).count() == 0 and got.filter((F.col("doc_id") % 4 != 0) & ~F.col("kept")).count() == 0
    want = Counter((r[0], *brute_stats(r[1] or "")) for r in rows)
    told = quality_rules.quality_rules(docs, labels).collect()
    assert Counter(tuple(r)[:6] for r in told) == want
    for r in told:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and (not r["kept"] or not r["base_failed"])
    kept = quality_rules.keep_quality(docs, labels.limit(0))
    assert kept.schema == docs.schema
    assert kept.count() == sum(not r["base_failed"] for r in quality_rules.quality_rules(docs, labels.limit(0)).collect())
    assert quality_rules.quality_rules(empty, labels).count() == 0 and quality_rules.keep_quality(empty, labels).count() == 0


def test_sample_is_bounded_and_whole(marked):
    good, labels = marked
    assert len(quality_sample(good, labels, 50)) == 50
    table = quality_sample(good, labels, 5000)
    assert len(table) == 600 and sum(table.column("label").to_pylist()) == 450


def test_chunks_cover_whole_documents():
    texts = ["", "a", "b" * 256, "c" * 257, "d" * 5000]
    chunks, n = byte_cnn.chunk_table(*flat(pa.array(texts)))
    assert n.tolist() == [1, 1, 1, 2, 23]
    at = 0
    for t, k in zip(texts, n, strict=True):
        covered = set()
        for c in range(k):
            size = int((chunks[at + c] != 0).sum())
            covered |= set(range(c * byte_cnn.STEP, c * byte_cnn.STEP + size))
        assert covered == set(range(len(t)))
        at += k


def test_pooling_is_a_plain_convolution(marked):
    rng = np.random.default_rng(3)
    net = byte_cnn.ByteCnn(rng.normal(size=(256, byte_cnn.EMBED - 1)).astype("f4"), rng.normal(size=(byte_cnn.WIDTH * byte_cnn.EMBED, byte_cnn.FILTERS)).astype("f4"), rng.normal(size=byte_cnn.FILTERS).astype("f4"), np.zeros(2 * byte_cnn.FILTERS, "f4"), 0.0)
    chunk = rng.integers(1, 256, (1, byte_cnn.CHUNK)).astype(np.uint8)
    chunk[0, 40:80] = chunk[0, 20:60]
    best = np.full(byte_cnn.FILTERS, -np.inf)
    for place in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
        vectors = []
        for k in range(place, place + byte_cnn.WIDTH):
            four = bytes(chunk[0, k : k + 4])
            again = len(four) == 4 and any(bytes(chunk[0, k - lag : k - lag + 4]) == four for lag in range(1, byte_cnn.LAGS + 1) if k >= lag)
            vectors.append(np.append(net.embed[chunk[0, k]], again))
        best = np.maximum(best, np.concatenate(vectors) @ net.filters)
    assert np.allclose(net.pooled(chunk)[0], np.maximum(best + net.bias, 0), atol=1e-3)


def test_cnn_on_held_out(marked, docs, rows, empty):
    good, labels = marked
    net = byte_cnn.fit_quality_cnn(good, labels, id_crc(F.col("labelled")) % 3 != 1)
    got = byte_cnn.score_quality(good, net).withColumn("held", id_crc(F.col("doc_id")) % 3 == 1).filter("held").collect()
    assert len(got) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got]) > 0.97
    odd = byte_cnn.score_quality(docs, net).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in byte_cnn.score_quality(docs, byte_cnn.fit_quality_cnn(docs, labels.limit(0))).collect()} == {0.5}
    assert byte_cnn.score_quality(empty, net).count() == 0


def test_codes():
    for n in (1, 2, 4, 7, 8, 40):
        code = language_id.code_matrix(n)
        assert len({tuple(c) for c in code}) == n
        if n > 2:
            apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
            assert apart.min() >= 3 or n == 3


def test_grams_stay_in_their_row():
    both = language_id.gram_shares(*flat(pa.array(["ab", "cd", "", "Xyz"])))
    for k, t in enumerate(["ab", "cd", "", "xyz"]):
        assert np.allclose(both[k], language_id.gram_shares(*flat(pa.array([t])))[0])


def test_language_id_on_held_out(spark, docs, rows, empty):
    rnd = random.Random(11)
    parts = {"aa": ["the", "ing", "th", "er"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["ción", "que", "ñ", "ll"], "dd": ["eau", "oi", "è", "tion"], "ee": ["ij", "oo", "een", "sch"]}
    made = [(i, " ".join("".join(rnd.choices(parts[lang], k=3)) for _ in range(rnd.randint(4, 40))), lang) for i in range(900) for lang in [rnd.choice(list(parts))]]
    d = spark.createDataFrame([*made, (1000, "the ing", None), (1001, None, "aa"), (1002, "123 !?", "bb"), (1003, "", "cc")], "doc_id bigint, text string, lang string")
    held = id_crc(F.col("doc_id")) % 4 == 2
    book = language_id.fit_languages(d, ~held)
    assert book.code.shape == (5, 15)
    got = {r["doc_id"]: r for r in language_id.language_id(d, book).withColumn("held", held).collect()}
    test = [(got[i]["lang_pred"], lang) for i, _, lang in made if got[i]["held"]]
    assert len(test) > 150 and np.mean([a == b for a, b in test]) > 0.97
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3 and got[1000]["lang_pred"] == "aa"
    odd = language_id.language_id(docs, book).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in language_id.language_id(docs, None).collect()} == {"und"}
    assert language_id.fit_languages(empty) is None and language_id.language_id(empty, book).count() == 0
    one = language_id.fit_languages(d.filter("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_id.language_id(d.filter("doc_id < 50"), one).collect()} == {"aa"}
