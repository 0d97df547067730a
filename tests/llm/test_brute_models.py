"""Language scores and quality scores of whole texts, recounted in plain Python; long texts in pieces."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import byte_cnn, common, doc_stats, language_id, minhash
from sievelake.llm.common import flat


def gram_counts(text: str) -> Counter:
    body = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    factors, out = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F), Counter()
    for n in (2, 3, 4):
        for i in range(len(body) - n + 1):
            h = n * 0x01000193
            for k in range(n):
                h = ((h ^ body[i + k]) * factors[k]) % 2**32
            out[h >> 20] += 1
    return out


def decoded(text: str, book: language_id.Codebook) -> tuple[str, float, bool]:
    counts = gram_counts(text)
    total = max(sum(counts.values()), 1)
    answers = []
    for bit in range(book.code.shape[1]):
        answers.append(book.bias[bit] + sum(math.sqrt(c / total) * float(book.weights[g, bit]) for g, c in counts.items()))
    losses = [sum(book.trust[b] * math.log1p(math.exp(-word[b] * f)) for b, f in enumerate(answers)) for word in book.code]
    scale = sum(book.trust) / max(1.0, math.log2(len(book.languages) + 1))
    share = [math.exp(-(x - min(losses)) / scale * 4) for x in losses]
    share = sorted((s / sum(share) for s in share), reverse=True)
    best = losses.index(min(losses))
    return book.languages[best], share[0], share[0] - (share[1] if len(share) > 1 else 0) < language_id.AMBIGUOUS


@pytest.fixture(scope="module")
def book():
    rng = np.random.default_rng(8)
    code = language_id.code_matrix(5)
    bits = code.shape[1]
    return language_id.Codebook(["aa", "bb", "cc", "dd", "ee"], code, rng.normal(0, 0.6, (language_id.BUCKETS, bits)).astype(np.float32), rng.normal(0, 0.1, bits), rng.random(bits) + 0.1)


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_language_of_whole_texts(spark, docs, rows, book, monkeypatch, piece):
    texts = [r[1] or "" for r in rows]
    monkeypatch.setattr(language_id, "PIECE", piece)
    shares = language_id.gram_shares(*flat(pa.array(texts[:60])))
    for text, got in zip(texts[:60], shares, strict=True):
        counts = gram_counts(text)
        want = np.zeros(language_id.BUCKETS)
        for g, c in counts.items():
            want[g] = math.sqrt(c / sum(counts.values()))
        assert np.allclose(got, want, atol=1e-6)
    if piece > 7:
        want = Counter()
        for r in rows:
            known = r[1] is not None and any(c.isalpha() for c in r[1])
            lang, score, close = decoded(r[1], book) if known else ("und", 0.0, True)
            want[r[0], lang, round(score, 3), close] += 1
        got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 3), r["ambiguous"]) for r in language_id.language_id(docs, book).collect())
        assert sum((got - want).values()) <= 2  # a third decimal may round either way
        assert {x[:2] for x in got} == {x[:2] for x in want} and {x[3] for x in got} == {True, False}


def test_ties_go_to_the_first_name_and_are_ambiguous():
    code = language_id.code_matrix(4)
    flat_book = language_id.Codebook(["aa", "bb", "cc", "dd"], code, np.zeros((language_id.BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    best, score, close = flat_book.decode(language_id.gram_shares(*flat(pa.array(["any text", "x"]))))
    assert best.tolist() == [0, 0] and np.allclose(score, 0.25) and close.all()


def plain_score(net: byte_cnn.ByteCnn, text: str) -> float:
    body, pooled = text.encode(), []
    n = 1 + max(0, math.ceil((len(body) - byte_cnn.CHUNK) / byte_cnn.STEP))
    for c in range(n):
        chunk = body[c * byte_cnn.STEP : c * byte_cnn.STEP + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0")
        vectors = []
        for k in range(byte_cnn.CHUNK):
            four = chunk[k : k + 4]
            again = len(four) == 4 and chunk[k] != 0 and any(chunk[k - lag : k - lag + 4] == four for lag in range(1, byte_cnn.LAGS + 1) if k >= lag)
            vectors.append(np.append(net.embed[chunk[k]], again))
        e = np.array(vectors)
        places = range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE)
        answers = np.stack([e[p : p + byte_cnn.WIDTH].ravel() @ net.filters for p in places])
        pooled.append(np.maximum(answers.max(axis=0) + net.bias, 0))
    z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ net.out + net.out_bias
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("part", [8192, 3])
def test_quality_of_whole_documents(spark, docs, rows, monkeypatch, part):
    monkeypatch.setattr(byte_cnn, "PART", part)
    rng = np.random.default_rng(2)
    f = byte_cnn.FILTERS
    net = byte_cnn.ByteCnn(rng.normal(0, 0.5, (256, byte_cnn.EMBED - 1)).astype("f4"), rng.normal(0, 0.2, (byte_cnn.WIDTH * byte_cnn.EMBED, f)).astype("f4"), rng.normal(size=f).astype("f4"), rng.normal(0, 0.1, 2 * f).astype("f4"), 0.1)
    texts = [t for t in dict.fromkeys(r[1] or "" for r in rows) if len(t) < 3000]
    got = net.score(*flat(pa.array(texts)))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)
    if part > 3:
        by_text = dict(zip(texts, got, strict=True))
        want = sorted((str(r[0]), round(by_text[r[1] or ""], 4)) for r in rows if (r[1] or "") in by_text)
        told = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in byte_cnn.score_quality(docs, net).collect())
        assert len([x for x in want if x not in set(told)]) <= 2  # a fourth decimal may round either way


def test_long_texts_are_learned_from_evenly(spark, monkeypatch):
    monkeypatch.setattr(byte_cnn, "LEARNED_CHUNKS", 4)
    seen = []
    monkeypatch.setattr(byte_cnn, "fit_chunks", lambda chunks, n, labels, seed=5: seen.append((chunks, n, labels)))
    text = "".join(chr(97 + i // 224) for i in range(224 * 20))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id int, text string")
    byte_cnn.fit_quality_cnn(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id int, quality int"))
    ((chunks, n, labels),) = seen
    assert sorted(zip(n.tolist(), labels.tolist(), strict=True)) == [(1, 0), (1, 1), (4, 1)]
    first = int(n[: n.tolist().index(4)].sum())
    assert [chr(c[0]) for c in chunks[first : first + 4]] == ["a", "f", "k", "p"]


def test_spans_are_hashed_alike_in_segments(rows, monkeypatch):
    rnd = random.Random(6)
    data, offsets = flat(pa.array([r[1] or "" for r in rows]))
    cuts = np.sort(np.array(rnd.sample(range(len(data) + 1), 400)))
    start, end = cuts[::2], cuts[1::2]
    want = common.span_hash(common.prefix_hash(common.BYTE_CODES[data]), start, end)
    stats, shingles = doc_stats.base_stats(data, offsets), minhash.shingle_sets(data, offsets, 3)[0]
    for segment in (1 << 20, 1000, 64):
        monkeypatch.setattr(common, "SEGMENT", segment)
        assert (common.hashed_spans(data, start, end) == want).all()
        assert all((v == stats[k]).all() for k, v in doc_stats.base_stats(data, offsets).items())
        assert (minhash.shingle_sets(data, offsets, 3)[0] == shingles).all()
    empty = np.zeros(0, np.int64)
    assert len(common.hashed_spans(np.zeros(0, np.uint8), empty, empty)) == 0
