"""Bounded samples of labelled documents, to fit the small models on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LONGEST = 64 << 10  # bytes of a text that comes to the driver to be learned from; of a longer one, as many evenly from all of it


def id_crc(doc_id: Column) -> Column:
    """The unsigned CRC-32 of a document's id as text."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary"))


def quality_rows(docs: DataFrame, labels: DataFrame, size: int, fold: Column | None = None) -> DataFrame:
    """Columns doc_id, text (null: empty) and label of the rows whose label is among the `size` whose id hashes lowest.

    Labels of null, or other than 0 and 1, don't count; an id that has both labels counts as 0.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("labelled"), labels["quality"].cast("int").alias("label")).filter("labelled IS NOT NULL AND label IN (0, 1)")
    if fold is not None:
        marks = marks.filter(fold)
    marks = marks.groupBy("labelled").agg(F.min("label").alias("label")).orderBy(F.xxhash64("labelled"), "labelled").limit(size)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # at most `size` rows of two numbers are broadcast
    return rows.join(F.broadcast(marks), rows["doc_id"] == marks["labelled"]).select("doc_id", "text", "label")


def first_by_id(rows: DataFrame, size: int, body: str) -> DataFrame:
    """At most `size` rows, those whose id hashes lowest; of rows equal in id, by their bodies."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64(body)).limit(size)


def quality_sample(docs: DataFrame, labels: DataFrame, size: int, fold: Column | None = None) -> pa.Table:
    """Columns doc_id, text and label of at most `size` labelled rows, on the driver: for texts of bounded length."""
    return first_by_id(quality_rows(docs, labels, size, fold), size, "text").toArrow()
