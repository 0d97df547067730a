from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.queries import queries
from sievelake.store import Store


def test_all_values_are_asked(spark, tmp_path):
    spark.range(450).select(F.col("id").alias("event_id"), F.concat(F.lit("kind "), F.col("id") % 150).alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(450).select(F.col("id").alias("o_orderkey"), F.concat(F.lit("kind "), F.col("id") % 150).alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    told = {r["event_type"]: r["maybe"] for r in queries()["bloom_maybe_contains"](spark, str(tmp_path)).collect()}
    assert told == {**{f"kind {i}": True for i in range(150)}, "no such event": False}
    counts = {r["o_orderpriority"]: r["estimate"] for r in queries()["cms_estimate"](spark, str(tmp_path)).collect()}
    assert set(counts) == {*(f"kind {i}" for i in range(150)), "never"} and all(counts[f"kind {i}"] >= 3 for i in range(150))


def test_as_one_by_one(spark):
    store = Store.from_df(spark.range(3000).select("id", (F.col("id") % 900 / 4).alias("row")), "id")
    asked = spark.range(1000).select((F.col("id") / 4 + 100).alias("row"))
    assert all(r["maybe"] == store.maybe_contains("row", r["row"]) for r in store.maybe_contains_each("row", asked).collect())
    assert all(r["estimate"] == store.estimate_count("row", r["row"]) for r in store.estimate_count_each("row", asked).collect())
