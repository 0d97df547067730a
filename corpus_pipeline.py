"""A corpus from raw documents: quality rules, exact and near dedup, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before it kept; its
result is written as Parquet and read again as the next one's docs. All but the last return the columns of docs.

Special cases: null texts count as empty; texts of fewer than 20 words go in the first stage, so null and empty ones
do; of rows equal in text the one with the largest id stays, of a component of near copies the one with the least,
null ids last; rows equal in id and text are one document after the second stage; further columns go along, whatever
their names; texts may be of any length; an empty table gives an empty result. With labels of only one kind, the first
stage has its two fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm.common import documents
from sievelake.llm.exact_dedup import keep_distinct
from sievelake.llm.minhash import keep_one
from sievelake.llm.packing import pack
from sievelake.llm.quality_rules import keep_quality
from sievelake.llm.queries import END_ID, tokenizer_path
from sievelake.llm.suffix_dedup import cut_repeats
from sievelake.shared import is_written, remove_path, scratch_path, shuffles_freed

NEAR_WORDS, NEAR_PERCENT = 5, 80
REPEAT_WORDS = 51  # passages of over 50 words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs, words=REPEAT_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The stages fit a model, follow links and run a tokenizer: not for SQL. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """The packed corpus of sf_dir's documents.

    `work`: a folder in a store that all executors share. The stages' tables are kept there, and a run that finds some
    of them written goes on after the last one. Without it they lie in the checkpoint folder and are removed as soon
    as the next stage is written, and when a stage fails.
    """
    docs, base = documents(spark, sf_dir), work or scratch_path(spark, "pipeline")
    before = None
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            to = f"{base.rstrip('/')}/{k}-{name}"
            if not (work and is_written(spark, to)):
                with shuffles_freed(spark):
                    stage(spark, docs, sf_dir).write.mode("overwrite").parquet(to)
            if before and not work:
                remove_path(spark, before)
            docs, before = spark.read.parquet(to), to
        return STAGES[-1][1](spark, docs, sf_dir)  # which has a checkpoint of all that it needs
    finally:
        if not work:
            remove_path(spark, base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
