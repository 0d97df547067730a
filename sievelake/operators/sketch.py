"""Bloom and Count-Min sketches as small tables of positions and cells.

A sketch's table has at most `bits`, or rows * width, rows whatever the data: building one is an aggregation,
combined before the shuffle, and asking it is a matter of the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.display import display, display_of
from sievelake.plans.compile import column

# The standard sizes.
BLOOM_BITS, BLOOM_HASHES = 16384, 5
COUNT_ROWS, COUNT_WIDTH = 5, 1024
DIGEST_BYTES = 16


def _word(digest_hex: Column, byte: int) -> Column:
    """The big-endian 32-bit word at a byte of a hexadecimal digest."""
    return F.conv(F.substring(digest_hex, 1 + 2 * byte, 8), 16, 10).cast("bigint")


def bloom_positions(text: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """The bits that a value sets. The digest has four words, so a fifth hash is the first one again."""
    digest = F.md5(text.cast("binary"))
    return F.array(*[F.pmod(_word(digest, 4 * i % DIGEST_BYTES), F.lit(bits)).cast("bigint") for i in range(hashes)])


def bloom_positions_of(value: Any, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> list[int]:
    digest = hashlib.md5(display_of(value).encode(), usedforsecurity=False).digest()
    return [int.from_bytes(digest[4 * i % DIGEST_BYTES :][:4], "big") % bits for i in range(hashes)]


def count_columns(text: Column, rows: int = COUNT_ROWS, width: int = COUNT_WIDTH) -> Column:
    """The column of a value's cell in each row: its text and the row's number as one byte, digested."""
    salted = lambda r: F.md5(F.concat(text.cast("binary"), F.unhex(F.lit(f"{r:02x}"))))
    return F.array(*[F.pmod(_word(salted(r), 0), F.lit(width)).cast("bigint") for r in range(rows)])


def count_columns_of(value: Any, rows: int = COUNT_ROWS, width: int = COUNT_WIDTH) -> list[int]:
    text = display_of(value).encode()
    return [int.from_bytes(hashlib.md5(text + bytes([r]), usedforsecurity=False).digest()[:4], "big") % width for r in range(rows)]


def _shown(df: DataFrame, attribute: str) -> Column:
    return display(column(attribute), df.schema[attribute].dataType)


def bloom_table(df: DataFrame, attribute: str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """pos: the bits that are set by the attribute's values."""
    shown = df.filter(column(attribute).isNotNull()).select(_shown(df, attribute).alias("shown"))
    return shown.select(F.explode(bloom_positions(F.col("shown"), bits, hashes)).alias("pos")).distinct()


def count_table(df: DataFrame, attribute: str, rows: int = COUNT_ROWS, width: int = COUNT_WIDTH) -> DataFrame:
    """row, col and cnt of the cells that aren't empty. Equal values are counted before they are hashed."""
    shown = df.filter(column(attribute).isNotNull()).groupBy(_shown(df, attribute).alias("shown")).agg(F.count(F.lit(1)).alias("n"))
    cells = shown.select("n", F.posexplode(count_columns(F.col("shown"), rows, width)).alias("row", "col"))
    return cells.groupBy("row", "col").agg(F.sum("n").alias("cnt"))


def bloom_asked(table: DataFrame, values: DataFrame, attribute: str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """Of each distinct value of the attribute whether a bloom_table may contain it (maybe)."""
    asked = values.select(column(attribute).alias("asked"), _shown(values, attribute).alias("shown")).distinct()
    at = asked.select("asked", F.explode(bloom_positions(F.col("shown"), bits, hashes)).alias("pos"))
    found = at.join(F.broadcast(table.withColumn("set", F.lit(True))), "pos", "left")  # `bits` rows at most
    return found.groupBy("asked").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("maybe")).withColumnRenamed("asked", attribute)


def count_asked(table: DataFrame, values: DataFrame, attribute: str, rows: int = COUNT_ROWS, width: int = COUNT_WIDTH) -> DataFrame:
    """Of each distinct value of the attribute the estimate that a count_table gives."""
    asked = values.select(column(attribute).alias("asked"), _shown(values, attribute).alias("shown")).distinct()
    at = asked.select("asked", F.posexplode(count_columns(F.col("shown"), rows, width)).alias("row", "col"))
    found = at.join(F.broadcast(table), ["row", "col"], "left")  # rows * width at most
    return found.groupBy("asked").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate")).withColumnRenamed("asked", attribute)


@dataclass(frozen=True)
class BloomSketch:
    """Which values may have been seen: no seen value is ever denied."""

    set_bits: frozenset[int]
    bits: int = BLOOM_BITS
    hashes: int = BLOOM_HASHES

    @classmethod
    def of(cls, df: DataFrame, attribute: str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> BloomSketch:
        return cls(frozenset(r[0] for r in bloom_table(df, attribute, bits, hashes).collect()), bits, hashes)  # `bits` rows at most

    def maybe_contains(self, value: Any) -> bool:
        return set(bloom_positions_of(value, self.bits, self.hashes)) <= self.set_bits


@dataclass(frozen=True)
class CountMinSketch:
    """How often values have been seen, never too low."""

    cells: dict[tuple[int, int], int]
    rows: int = COUNT_ROWS
    width: int = COUNT_WIDTH

    @classmethod
    def of(cls, df: DataFrame, attribute: str, rows: int = COUNT_ROWS, width: int = COUNT_WIDTH) -> CountMinSketch:
        return cls({(r["row"], r["col"]): r["cnt"] for r in count_table(df, attribute, rows, width).collect()}, rows, width)  # rows * width at most

    def estimate(self, value: Any) -> int:
        return min(self.cells.get((r, c), 0) for r, c in enumerate(count_columns_of(value, self.rows, self.width)))
