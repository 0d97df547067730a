"""A byte-level convolutional quality classifier in numpy.

A document is cut into overlapping chunks that cover all of it. Each byte of a chunk becomes a learned vector,
with one entry more that tells whether the four bytes from there on repeat those of up to LAGS places before.
Learned filters run over these vectors; each filter's largest answer in the chunk is kept, and a document's chunks are combined by the mean
and the maximum of each filter into one probability. Gradients flow only to the places that won a maximum, so
training on a bounded sample of labelled rows takes seconds on the driver.

Bytes after a chunk's end count as zero bytes, which no text needs. Results for the special cases: null and
empty texts are one chunk of zero bytes and get a score like any other; rows equal in id are scored each for
itself; with fewer than MIN_LABELS labels of either kind every score is 0.5; a text of any length is scored as a
whole, PART chunks at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from sievelake.llm.common import bounded_batches, flat, slices, texts
from sievelake.llm.labelled import LONGEST, first_by_id, quality_rows

SAMPLE = 4000  # labelled rows at most
MIN_LABELS = 8
CHUNK, STEP = 256, 224  # bytes of a chunk, and from one chunk to the next
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 8, 32
LAGS = 32
BATCH, RATE = 64, 4e-3
EPOCHS, MIN_STEPS = 12, 500  # of training: so many epochs, and more of them on small samples
LEARNED_CHUNKS = 1 + -(-(LONGEST - CHUNK) // STEP)  # of a document that training may draw from, evenly from all of it
PART = 8192  # chunks that are scored at once
TRAIN_CHUNKS = 16  # of a document in one training step, drawn anew in each epoch; scoring takes all chunks


def chunk_counts(offsets: np.ndarray) -> np.ndarray:
    """How many chunks each row has, one at least."""
    return 1 + np.maximum(0, -(-(np.diff(offsets) - CHUNK) // STEP))


def chunks_at(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Chunks of rows as a matrix of bytes."""
    where = (offsets[row] + nth * STEP)[:, None] + np.arange(CHUNK)
    inside = where < offsets[row + 1][:, None]
    padded = np.append(data, np.uint8(0)) if not len(data) else data
    return np.where(inside, padded[np.minimum(where, len(padded) - 1)], np.uint8(0))


def chunk_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all rows, and how many each row has."""
    n = chunk_counts(offsets)
    row = np.repeat(np.arange(len(n)), n)
    return chunks_at(data, offsets, row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)), n


def repeats(chunks: np.ndarray) -> np.ndarray:
    """Of each byte of each chunk whether the four bytes from it on equal those from one of the LAGS places before it on."""
    wide = chunks.astype(np.uint32)
    four = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    out = np.zeros(chunks.shape, bool)
    for lag in range(1, LAGS + 1):
        out[:, lag:-3] |= four[:, lag:] == four[:, :-lag]
    return out & (chunks != 0)


@dataclass
class ByteCnn:
    embed: np.ndarray  # 256 x EMBED - 1
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float

    def patches(self, chunks: np.ndarray) -> np.ndarray:
        """The embedded windows of each chunk: chunk x place x WIDTH * EMBED."""
        e = np.empty((len(chunks), CHUNK, EMBED), np.float32)
        e[:, :, :-1] = self.embed[chunks]
        e[:, :, -1] = repeats(chunks)
        e = e.reshape(len(chunks), CHUNK * EMBED)
        places = (CHUNK - WIDTH) // STRIDE + 1
        s = e.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(chunks), places, WIDTH * EMBED), (s[0], STRIDE * EMBED * s[1], s[1])))

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's largest answer in each chunk, cut off below 0."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for at in range(0, len(chunks), 256):  # bounds the windows' memory
            a = self.patches(chunks[at : at + 256])
            out[at : at + 256] = (a.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(a), -1, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of whole rows. PART chunks are looked at at once, so that memory doesn't grow with a row's length."""
        n = chunk_counts(offsets)
        first = np.cumsum(n) - n
        total, most = np.zeros((len(n), FILTERS), np.float32), np.zeros((len(n), FILTERS), np.float32)
        for begin in range(0, int(n.sum()), PART):
            ids = np.arange(begin, min(begin + PART, int(n.sum())))
            row = np.searchsorted(first, ids, side="right") - 1
            pooled = self.pooled(chunks_at(data, offsets, row, ids - first[row]))
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[at]] += np.add.reduceat(pooled, at, axis=0)
            most[row[at]] = np.maximum(most[row[at]], np.maximum.reduceat(pooled, at, axis=0))
        z = np.concatenate([total / n[:, None], most], axis=1) @ self.out + self.out_bias
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).astype(float)


def fit_cnn(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int = 5) -> ByteCnn | None:
    return fit_chunks(*chunk_table(data, offsets), labels, seed)


def fit_chunks(chunks: np.ndarray, n: np.ndarray, labels: np.ndarray, seed: int = 5) -> ByteCnn | None:
    """From documents' chunks, end to end, and how many each document has."""
    if min((labels == 0).sum(), (labels == 1).sum()) < MIN_LABELS:
        return None
    rng = np.random.default_rng(seed)
    first = np.cumsum(n) - n
    f4 = np.float32
    net = ByteCnn(rng.normal(0, 0.5, (256, EMBED - 1)).astype(f4), rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(f4), np.zeros(FILTERS, f4), np.zeros(2 * FILTERS, f4), 0.0)
    ones = float((labels == 1).mean())
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones)) ** 0.5
    params = ["embed", "filters", "bias", "out", "out_bias"]
    m = {p: 0.0 for p in params}
    v = {p: 0.0 for p in params}
    t = 0
    epochs = max(EPOCHS, MIN_STEPS * BATCH // len(labels))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), BATCH):
            docs = order[b : b + BATCH]
            take = [first[d] + (rng.choice(n[d], TRAIN_CHUNKS, replace=False) if n[d] > TRAIN_CHUNKS else np.arange(n[d])) for d in docs]
            k = np.array([len(x) for x in take])
            ids = np.concatenate(take)
            batch = chunks[ids]
            a = net.patches(batch)
            answers = (a.reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(a), -1, FILTERS)
            where = answers.argmax(axis=1)
            top = np.take_along_axis(answers, where[:, None, :], 1)[:, 0, :] + net.bias
            pooled = np.maximum(top, 0)
            at = np.cumsum(k) - k
            mean = np.add.reduceat(pooled, at, axis=0) / k[:, None]
            most = np.maximum.reduceat(pooled, at, axis=0)
            x = np.concatenate([mean, most], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.out_bias, -30, 30)))
            dz = ((p - labels[docs]) * weight[docs] / len(docs)).astype(f4)
            dx = dz[:, None] * net.out
            doc = np.repeat(np.arange(len(docs)), k)
            winner = pooled >= most[doc]
            dpool = dx[doc, :FILTERS] / k[doc][:, None] + np.where(winner, dx[doc, FILTERS:], 0)
            dpool = np.where(top > 0, dpool, 0).astype(f4)
            # only the winning windows: chunk x filter
            won = a[np.arange(len(a))[:, None], where]  # chunk x filter x WIDTH * EMBED
            dfilters = np.einsum("cf,cfw->wf", dpool, won)
            dwon = (dpool[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            bytes_at = (where * STRIDE)[:, :, None] + np.arange(WIDTH)
            letters = batch[np.arange(len(a))[:, None, None], bytes_at].reshape(-1)
            dembed = np.stack([np.bincount(letters, dwon[:, e], 256) for e in range(EMBED - 1)], axis=1)
            grads = {"embed": dembed, "filters": dfilters, "bias": dpool.sum(axis=0), "out": x.T @ dz + 1e-4 * net.out, "out_bias": float(dz.sum())}
            t += 1
            rate = RATE * (1 - 0.9 * (epoch * len(order) + b) / (epochs * len(order)))
            for q in params:
                m[q] = 0.9 * m[q] + 0.1 * grads[q]
                v[q] = 0.99 * v[q] + 0.01 * grads[q] ** 2
                step = rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.99**t)) + 1e-8)
                now = getattr(net, q) - step
                setattr(net, q, now.astype(f4) if isinstance(now, np.ndarray) else float(now))
    return net


def fit_quality_cnn(docs: DataFrame, labels: DataFrame, fold: Column | None = None) -> ByteCnn | None:
    """Fitted on at most SAMPLE labelled rows; `fold` is a condition on the column `labelled`, their id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = flat(b.column("text"))
            n = chunk_counts(offsets)
            taken = np.minimum(n, LEARNED_CHUNKS)
            row = np.repeat(np.arange(len(n)), taken)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
            chunks = chunks_at(data, offsets, row, nth * n[row] // taken[row])
            ends = np.cumsum(taken) * CHUNK
            bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(np.int64(0), ends)), pa.py_buffer(chunks.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), bodies.cast(pa.binary())], ["doc_id", "label", "chunks"])

    bounded_batches(docs.sparkSession)
    sample = first_by_id(quality_rows(docs, labels, SAMPLE, fold).mapInArrow(cut, "doc_id long, label int, chunks binary"), SAMPLE, "chunks").toArrow()
    if not len(sample):
        return None
    bodies = sample.column("chunks").to_pylist()
    chunks = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, CHUNK)
    return fit_chunks(chunks, np.array([len(x) // CHUNK for x in bodies]), np.asarray(sample.column("label")))


def score_quality(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """doc_id, score and predicted of each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            score = net.score(*flat(b.column("text"))) if net else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
