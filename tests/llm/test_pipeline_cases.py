"""The pipeline over empty and labelled tables, after failures, and with further columns."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from sievelake.shared import shared_dir

LABELS = "doc_id bigint, quality int, toxic int"


def tables(spark, to, docs, labels):
    docs.write.mode("overwrite").parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{to}/labels.parquet")
    return str(to)


def left_behind(spark):
    return sorted(p.name for p in Path(shared_dir(spark).removeprefix("file:")).rglob("pipeline-*"))


def test_empty_tables(spark, empty, tmp_path):
    got = pipeline.run(spark, tables(spark, tmp_path, empty, []))
    assert got.count() == 0 and got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = empty
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == empty.columns


@pytest.fixture(scope="module")
def labelled(spark):
    """Of 400 documents every fourth is symbol spam, and labelled 0."""
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        words = ["".join(rnd.choices(["ne", "ka", "li", "to", "re"], k=rnd.randint(1, 3))) for _ in range(rnd.randint(25, 90))]
        rows.append((i, " ".join(w + "$$$" * (i % 4 == 0 and rnd.random() < 0.6) for w in words), "more"))
    return spark.createDataFrame([*rows, (None, None, "x"), (500, "", "x"), (501, "too short", None)], "doc_id bigint, text string, `key.of` string"), [(i, int(i % 4 != 0), 0) for i in range(300)]


def test_fitted_quality_takes_effect(spark, labelled, tmp_path):
    docs, labels = labelled
    where = tables(spark, tmp_path, docs, labels)
    kept = pipeline.quality_rules(spark, spark.read.parquet(f"{where}/documents.parquet"), where)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not any(i is None or i % 4 == 0 or i >= 500 for i in ids) and len(ids) > 280
    assert {r["doc_id"] for r in pipeline.run(spark, where).select("doc_id").collect()} <= ids


def test_a_run_goes_on_where_one_failed(spark, labelled, tmp_path, monkeypatch):
    where, work = tables(spark, tmp_path / "in", *labelled), str(tmp_path / "work")
    calls = []

    def counted(name, stage, fails):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if fails and name == "near_dedup":
                raise OSError("lost")
            return stage(spark, docs, sf_dir)

        return run

    stages = list(pipeline.STAGES)
    for fails in (True, False):
        monkeypatch.setattr(pipeline, "STAGES", [(n, counted(n, f, fails)) for n, f in stages])
        if fails:
            with pytest.raises(OSError):
                pipeline.run(spark, where, work)
        else:
            got = pipeline.run(spark, where, work).drop("sequence_id", "offset")
    assert calls == ["quality_rules", "exact_dedup", "near_dedup", "near_dedup", "repeated_passages", "packing"]
    monkeypatch.setattr(pipeline, "STAGES", stages)
    whole = pipeline.run(spark, where).drop("sequence_id", "offset")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_a_failed_run_leaves_no_tables(spark, labelled, tmp_path, monkeypatch):
    where, before = tables(spark, tmp_path, *labelled), left_behind(spark)

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(pipeline, "STAGES", [*pipeline.STAGES[:2], ("near_dedup", fails), *pipeline.STAGES[3:]])
    with pytest.raises(OSError):
        pipeline.run(spark, where)
    assert left_behind(spark) == before
