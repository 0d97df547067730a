"""Token ids as Parquet list columns, in ascending doc_id order, for selective reads.

Files hold one row for each document: shard, doc_id, local_start, n_tokens and the list `ids`. The ids are
dictionary-encoded (a vocabulary fits into one dictionary page a row group), the numbers beside them are
delta-encoded; row groups and pages are kept small and have column and offset indexes, so a reader that
wants a range of documents or only the counts reads just those pages. `start` of a document is the sum of
its shard's earlier shards (one row for each written task) and its local_start.

Results for the special cases: a null or empty text has the end id only; null ids come first; rows equal in id
follow each other, ordered by the first BEGINNING characters of their texts and then by the texts' hashes; they may
be a third of all rows, since ranges are of these, too; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.llm.common import bounded_batches, slices, texts

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 512
BEGINNING = 32  # characters of a text that rows of one id are ordered by


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievelake.llm.encoding import encoder

        enc, shard, before = encoder(path), TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", 2 << 20, keeps=True):
            ids, at = enc.rows(b.column("text"))
            ends = at[1:]
            ids = np.insert(ids, ends, end_id)
            at = at + np.arange(len(at))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, shard, np.int32)), b.column("doc_id"), pa.array(before + at[:-1]), pa.array(np.diff(at)), lists], ["shard", "doc_id", "local_start", "n_tokens", "ids"])
            before += int(at[-1])

    return run


def write_token_files(docs: DataFrame, to: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, append end_id, and write the files under `to`."""
    bounded_batches(docs.sparkSession)
    # rows of one id are spread by the beginning of their text, its hash, and where they are read; a range's bounds stay small
    order = [F.col("doc_id"), F.substring("text", 1, BEGINNING), F.xxhash64("text")]
    dealt = texts(docs).repartitionByRange(*order, F.spark_partition_id()).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(_encode(tokenizer, end_id), "shard int, doc_id long, local_start long, n_tokens long, ids array<int>")
    out = rows.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "true")
    for column in ("shard", "doc_id", "local_start", "n_tokens"):
        out = out.option(f"parquet.enable.dictionary#{column}", "false")
    out.parquet(to)


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The files' rows with `start`. Only the columns asked for are read; `where` on doc_id skips row groups and pages."""
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    rows = files if where is None else files.filter(where)
    # bases: one row for each task that wrote, whatever the number of documents
    out = rows.join(F.broadcast(bases), rows["shard"] == bases["of"])
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "ids"])) if columns and "start" not in columns else out.withColumn("start", F.col("base") + F.col("local_start")).select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        at = np.asarray(lists.offsets, np.int64)
        ids = memoryview(np.asarray(lists.values, "<u4")).cast("B")
        sums = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, from rows with their ids."""
    bounded_batches(rows.sparkSession)
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
