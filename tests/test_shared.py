from __future__ import annotations

from pathlib import Path

from sievelake.shared import checkpointed, shuffles_freed

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_bytes(spark) -> int:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.stat().st_size for top in manager.localDirs() for f in Path(str(top)).rglob("shuffle_*") if f.is_file())


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    spark.sparkContext._jvm.System.gc()
    before = shuffle_bytes(spark)
    rows = spark.range(300_000).selectExpr("id", "uuid() AS u").repartition(4, "id")
    assert checkpointed(rows).count() == 300_000
    assert shuffle_bytes(spark) < before + 1_000_000


def test_the_setting_is_put_back(spark):
    spark.conf.unset(KEY)
    unset = spark.conf.get(KEY, None)
    with shuffles_freed(spark):
        assert spark.conf.get(KEY) == "true"
    assert spark.conf.get(KEY, None) == unset
