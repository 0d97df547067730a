"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over byte n-grams says which side a
text is on. Decoding weighs each bit by how well its classifier did in training, adds up the logistic losses
against every codeword, and takes the codeword with the least; when the second is nearly as near, the answer is
flagged as ambiguous. Up to EXHAUSTIVE languages the code has every split of the languages into two sides;
beyond, seeded random splits, about 10 log2(languages) of them, of which the set with the widest least
distance between codewords is taken.

Features are the relative frequencies of hashed byte n-grams of the whole text, ASCII letters in lower case.

Results for the special cases: `und` with score 0 for a null text, a text without a letter, and every text if
no language could be learned; a language seen alone is learned as the only answer; of codewords that are equally
near, the language that comes first by name is the answer, and it is ambiguous; a text of any length is judged as a
whole, piece by piece in bounded memory; rows equal in id are judged each for itself; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import bounded_batches, flat, slices

PER_LANGUAGE, AT_LEAST, IN_ALL = 600, 20, 4000  # training documents of a language: at most, and of very many languages as few as AT_LEAST
EXHAUSTIVE = 7
BUCKETS = 1 << 12
GRAMS = (2, 3, 4)
PIECE = 1 << 20  # bytes whose n-grams are counted at once
STEPS, RATE, DECAY = 300, 4.0, 1e-5
AMBIGUOUS = 0.2  # of score between the best and the second
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def gram_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the square roots of the shares of its hashed n-grams; none reaches over a row's end."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * BUCKETS, np.float32)
    for begin in range(0, len(data), PIECE):  # bounds the working memory of long texts
        end = min(begin + PIECE, len(data))
        cuts = np.clip(offsets, begin, end)
        sizes = np.diff(cuts)
        at = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, sizes)
        left = np.repeat(offsets[1:], sizes) - np.arange(begin, end)  # bytes from here to the row's end
        codes = _LOWER[data[begin : end + max(GRAMS) - 1]]
        for n in GRAMS:
            m = min(end - begin, len(codes) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, np.uint32(n * 0x01000193))
            for k in range(n):
                h = (h ^ codes[k : k + m]) * _FACTORS[k]
            inside = left[:m] >= n
            counts += np.bincount(at[:m][inside] + (h[inside] >> np.uint32(20)), minlength=len(counts))
    out = counts.reshape(rows, BUCKETS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def code_matrix(languages: int) -> np.ndarray:
    """A codeword of -1 and 1 for each language."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        masks = np.arange(1, 2 ** (languages - 1))
        bits = (masks[None, :] >> np.arange(languages)[:, None]) & 1
        bits[-1] = 0
        return bits * 2.0 - 1
    width = int(np.ceil(10 * np.log2(languages)))
    rng = np.random.default_rng(languages)
    best, widest = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (languages, width)) * 2.0 - 1
        if np.any(np.abs(code.sum(axis=0)) == languages):
            continue
        apart = (width - code @ code.T) / 2 + np.eye(languages) * width
        if apart.min() > widest:
            best, widest = code, apart.min()
    assert best is not None
    return best


@dataclass
class Codebook:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the language's number, a score from 0 to 1, and whether the second is nearly as near."""
        f = x @ self.weights + self.bias
        losses = np.stack([(np.logaddexp(0, -c * f) * self.trust).sum(axis=1) for c in self.code], axis=1)
        scale = self.trust.sum() / max(1.0, np.log2(len(self.languages) + 1))
        share = np.exp(-(losses - losses.min(axis=1, keepdims=True)) / max(scale, 1e-9) * 4)
        share /= share.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        ranked = np.sort(share, axis=1)
        second = ranked[:, -2] if share.shape[1] > 1 else np.zeros(len(x))
        return best, share[np.arange(len(x)), best], ranked[:, -1] - second < AMBIGUOUS


def fit_codebook(x: np.ndarray, names: list[str]) -> Codebook | None:
    """One logistic classifier for each bit, all of them by the same full gradient steps with momentum."""
    languages = sorted(set(names))
    if not languages:
        return None
    code = code_matrix(len(languages))
    y = np.array([languages.index(n) for n in names])
    balance = 1.0 / np.bincount(y)[y]
    target = code[y]
    weights, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
    speed, share = np.zeros_like(weights), (balance / balance.sum())[:, None]
    if len(languages) > 1:
        for _ in range(STEPS):
            pull = -target / (1 + np.exp(target * (x @ weights + bias))) * share
            speed = 0.9 * speed - RATE * (x.T @ pull.astype(np.float32) + DECAY * weights)
            weights += speed
            bias -= RATE * 0.1 * pull.sum(axis=0)
    right = (share * ((x @ weights + bias) * target > 0)).sum(axis=0)
    trust = np.log((right + 0.01) / (1.01 - np.minimum(right, 1.0))).clip(0.05, 5)
    return Codebook(languages, code, weights, bias, trust)


def fit_languages(docs: DataFrame, learn: Column | None = None) -> Codebook | None:
    """From texts and all non-null lang of the rows where `learn` holds: of each language the ids that hash lowest,
    so many that there are about IN_ALL, and AT_LEAST of each; whole texts, however long."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(learn) if learn is not None else docs
    rows = rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["lang"].cast("string").alias("lang"), rows["text"].alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    most = max(AT_LEAST, min(PER_LANGUAGE, IN_ALL // max(1, rows.select("lang").distinct().count())))
    # IN_ALL rows of an id and a name are broadcast, or AT_LEAST of each language
    each = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("doc_id", "lang", F.row_number().over(each).alias("nth")).filter(F.col("nth") <= most).select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").orderBy("lang", F.xxhash64("doc_id"), "doc_id").select("lang", "text")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for at in range(0, b.num_rows, 512):  # bounds the n-gram table
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([x.tobytes() for x in gram_shares(*flat(part.column("text")))], pa.binary())], ["lang", "shares"])

    told = sample.mapInArrow(shares, "lang string, shares binary").toArrow()  # 16 KB a row, however long its text
    xs = [np.frombuffer(b"".join(b.column("shares").to_pylist()), np.float32).reshape(-1, BUCKETS) for b in told.to_batches()]
    return fit_codebook(np.concatenate(xs), told.column("lang").to_pylist()) if xs and told.num_rows else None


def language_id(docs: DataFrame, book: Codebook | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    names = np.array(book.languages if book else [UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n = b.num_rows
            best, score, close = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            if book:
                for at in range(0, n, 512):  # bounds the n-gram table
                    part = b.slice(at, 512)
                    best[at : at + 512], score[at : at + 512], close[at : at + 512] = book.decode(gram_shares(*flat(part.column("text"))))
            known = np.asarray(b.column("lettered").to_numpy(zero_copy_only=False), bool) & (book is not None)
            told = np.where(known, names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(told.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(close | ~known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
