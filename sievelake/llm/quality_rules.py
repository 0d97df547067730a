"""Quality rules: gradient-boosted trees over document statistics.

Two fixed rules reject what can't be judged or repeats itself; for the rest a boosted forest of small trees,
fitted on a bounded sample of labelled rows, gives a score. The trees are flattened into numpy node arrays and
all documents of a batch walk down them together. Chosen features are monotonic: more symbols, more repeated
lines or more repeated words never raise a score, because splits that would turn the order of two leaves
are not made and the values of later leaves stay within the bounds of earlier splits.

Results for the special cases: null and empty texts have no words and fail the base rules; rows equal in id
are judged each for itself; with fewer than MIN_LABELS labels of either kind there is no verdict, so what
passes the base rules is kept; a text of any length is measured as a whole, hashed a segment at a time; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelake.llm.common import bounded_batches, flat, slices, texts
from sievelake.llm.doc_stats import FEATURES, MONOTONE, base_stats, features
from sievelake.llm.labelled import first_by_id, quality_rows

SAMPLE = 4000  # labelled rows at most
MIN_LABELS = 8
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, L2 = 40, 3, 0.3, 48, 2.0, 1.0
KEEP_FROM = 0.35  # score from which a document is kept: rather let a doubtful one pass than lose a clean one
MIN_WORDS, MAX_REPEAT = 20, 30  # base rules: words at least, per cent of repeated words at most


@dataclass
class Forest:
    """Node arrays of all trees. A leaf is its own child, so that every walk takes DEPTH steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: np.ndarray) -> Forest | None:
    """monotone: for each feature -1, 0 or 1. None if there are too few labels of a kind."""
    if min((y == 0).sum(), (y == 1).sum()) < MIN_LABELS:
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.log((y == 1).sum() / (y == 0).sum()))
    total = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + L2), low, high))

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows], hess[rows]
        value = leaf(g.sum(), h.sum(), low, high)
        nodes.append([0, np.inf, at, at, RATE * value])
        best = (1e-6, -1, -1, 0.0, 0.0)
        if depth < DEPTH:
            gain = lambda a, b, v: -(a * v + 0.5 * (b + L2) * v * v)
            for f, c in enumerate(cuts):
                sg, sh = np.bincount(binned[rows, f], g, len(c) + 1), np.bincount(binned[rows, f], h, len(c) + 1)
                lg, lh = np.cumsum(sg)[:-1], np.cumsum(sh)[:-1]
                rg, rh = g.sum() - lg, h.sum() - lh
                lv, rv = np.clip(-lg / (lh + L2), low, high), np.clip(-rg / (rh + L2), low, high)
                good = (lh >= LEAST_WEIGHT) & (rh >= LEAST_WEIGHT) & ((rv - lv) * monotone[f] >= 0)
                won = np.where(good, gain(lg, lh, lv) + gain(rg, rh, rv) - gain(g.sum(), h.sum(), value), 0)
                if len(won) and won.max() > best[0]:
                    k = int(won.argmax())
                    best = (float(won[k]), f, k, float(lv[k]), float(rv[k]))
        _, f, k, lv, rv = best
        if f < 0:
            total[rows] += RATE * value
            return at
        goes = binned[rows, f] <= k
        middle = (lv + rv) / 2
        a, b = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, high), (low, high))
        nodes[at][:2] = [f, float(cuts[f][k])]
        nodes[at][2] = grow(rows[goes], depth + 1, *a)
        nodes[at][3] = grow(rows[~goes], depth + 1, *b)
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
    table = np.array(nodes)
    whole = lambda k: table[:, k].astype(np.int64)
    return Forest(np.array(roots), whole(0), table[:, 1], whole(2), whole(3), table[:, 4], base)


def fit_quality(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """The forest from at most SAMPLE labelled rows of `docs`, of which only the features come to the driver."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = flat(b.column("text"))
            x = np.ascontiguousarray(features(data, offsets, base_stats(data, offsets)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "label", "features"])

    bounded_batches(docs.sparkSession)
    sample = first_by_id(quality_rows(docs, labels, SAMPLE).mapInArrow(measured, "doc_id long, label int, features binary"), SAMPLE, "features").toArrow()
    if not len(sample):
        return None
    x = np.frombuffer(b"".join(sample.column("features").to_pylist())).reshape(-1, len(FEATURES))
    return fit_forest(x, np.asarray(sample.column("label")), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judged(column: pa.Array, forest: Forest | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in a string column: statistics, base_failed, score and kept."""
    data, offsets = flat(column)
    stats = base_stats(data, offsets)
    failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT * stats["n_words"])
    score = forest.score(features(data, offsets, stats)) if forest else np.ones(len(failed))
    return stats, failed, score, ~failed & (score >= KEEP_FROM)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of each row."""
    bounded_batches(docs.sparkSession)
    forest = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            stats, failed, score, kept = judged(b.column("text"), forest)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(stats[c]) for c in _COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *_COUNTS, "base_failed", "kept", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean, score double")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, that the rules keep."""
    bounded_batches(docs.sparkSession)
    forest = fit_quality(docs, labels)
    at = [n.lower() for n in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            text = pa.RecordBatch.from_arrays([whole.column(at).fill_null("")], ["text"])
            keep = [judged(part.column("text"), forest)[3] for part in slices(iter([text]), "text")]
            yield whole.filter(pa.array(np.concatenate(keep)))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow doesn't take every name
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
