"""What the corpus operators share: bounded Arrow batches, checkpoints, flat text buffers and hashes.

Every operator reads only the columns it names (`doc_id`, `text`), under names of its own, so further
columns with clashing names never reach its plan.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.shared import checkpointed, remove_path, scratch_path, shared_dir, shuffles_freed  # noqa: F401

BATCH_BYTES = 8 << 20  # of one Arrow batch that goes to Python; a single longer row still passes


def bounded_batches(spark: SparkSession) -> None:
    """Limit the bytes of the Arrow batches sent to Python, so that long texts don't add up there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "1g")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


HEAVY = 50_000  # keys that are spread at most; what is broadcast of them is a few MB
LIGHT_ROWS = 64  # so many rows of one key are no burden to a task


def shuffle_partitions(spark: SparkSession) -> int:
    """For shuffles before much work on few bytes: as many tasks as are configured, however small."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread_join(rows: DataFrame, counts: DataFrame, key: str, other: Column, n: int) -> DataFrame:
    """`rows` inner-joined with `counts`: a column `key` that is unique there, m (how many rows have it) and others.

    Keys with more than LIGHT_ROWS rows and more than one in HEAVY of the n rows, of which there can't be more than
    HEAVY, are looked up by a broadcast and their rows spread by `other`, which is of the key's type, so that no task
    has all of them. A key that isn't spread has 2 * 10^5 rows at most where there are 10^10.
    """
    mine, more = "spread key", [c for c in counts.columns if c != key]
    heavy = counts.filter(F.col("m") > max(n // HEAVY, LIGHT_ROWS)).select(F.col(key).alias("heavy key"), *[F.col(c).alias(f"heavy {c}") for c in more])
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("heavy key"), "left")
    spread = F.when(F.col("heavy key").isNull(), F.col(key)).otherwise(other)
    met = marked.join(counts.withColumnRenamed(key, mine), spread == F.col(mine), "left").filter(f"`heavy key` IS NOT NULL OR `{mine}` IS NOT NULL")
    light = F.col("heavy key").isNull()
    return met.select(*[rows[c] for c in rows.columns], *[F.when(light, F.col(c)).otherwise(F.col(f"heavy {c}")).alias(c) for c in more])


def likely_partitions(df: DataFrame) -> int:
    """About how many tasks read `df`, from the optimizer's size estimate; runs nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1, size // int(each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as a long, text as a string (null: empty) and the named columns."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *[docs[c] for c in more])


def row_key(doc_id: Column, body: Column) -> Column:
    """16 bytes that stand for an id and a text's bytes."""
    return F.unhex(F.substring(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), F.lit("|").cast("binary"), body), 256), 1, 32))


def single_threaded() -> None:
    """Native libraries in a Python worker use the task's one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


# --- flat buffers -------------------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and where each row starts and ends in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What a Python worker keeps over tasks. Tasks of other operators drop it.
worker_keeps: dict = {}


def drop_kept() -> None:
    if worker_keeps:
        worker_keeps.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)  # else the freed memory stays with the worker


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most `most` bytes in `column` (one row at least): bounds numpy's working memory."""
    if not keeps:
        drop_kept()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


BASE = 0x9E3779B97F4A7C55
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        have = (both[0], both[1])
        if size <= 1 << 22:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def prefix_hash(codes: np.ndarray, base: int = BASE) -> np.ndarray:
    """h with h[j] - h[i] = sum of codes[k] * base**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes), base)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of the spans: equal for equal spans wherever they lie."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start] + (end - start).astype(np.uint64))


SEGMENT = 1 << 20  # bytes that are hashed at once


def hashed_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """span_hash() of spans in the order of their places, with working memory for a segment, whatever the length of the data."""
    at_end, at_start = np.zeros(len(end), np.uint64), np.zeros(len(start), np.uint64)
    back = np.zeros(len(start), np.uint64)
    carry, ahead, behind, inverse = 0, 1, 1, pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(data) + 1, SEGMENT):
            part = data[begin : begin + SEGMENT]
            prefix = prefix_hash(BYTE_CODES[part], base) * np.uint64(ahead) + np.uint64(carry)
            for out, places in ((at_start, start), (at_end, end)):
                i, j = np.searchsorted(places, (begin, begin + SEGMENT))
                out[i:j] = prefix[places[i:j] - begin]
            i, j = np.searchsorted(start, (begin, begin + SEGMENT))
            back[i:j] = powers(len(prefix), base)[1][start[i:j] - begin] * np.uint64(behind)
            carry = int(prefix[-1])
            ahead, behind = ahead * pow(base, len(part), 1 << 64) % (1 << 64), behind * pow(inverse, len(part), 1 << 64) % (1 << 64)
    return mix64((at_end - at_start) * back + (end - start).astype(np.uint64))


WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+ and the row it lies in; words don't cross rows."""
    inside = WORD_BYTE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
