"""The pipeline stage by stage against brute force, and every registered query of this subpackage over a small table set."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from test_minhash import brute as near_brute
from test_repeated_words import without_repeats

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from sievelake.llm import quality_rules, queries
from sievelake.llm.labelled import id_crc

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, docs, rows, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    docs.select(*COLUMNS).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id bigint, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "repeated_passages", "packing"]
    kept = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = Counter(tuple(r) for r in docs.collect())
        kept.append(len(before))
        if k < 4:
            assert docs.columns == COLUMNS
        if name == "quality_rules":
            told = quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert sum(after.values()) == told.filter("kept").count() and not after - Counter(before)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[r[1]] = max((x for x in (best.get(r[1]), r[0]) if x is not None), default=None)
            assert Counter((r[0], r[1]) for r in after.elements()) == Counter((i, t) for t, i in best.items())
        elif name == "near_dedup":
            sets, roots = near_brute(before, pipeline.NEAR_WORDS, pipeline.NEAR_PERCENT)
            groups = {}
            for r, s, root in zip(before, sets, roots, strict=True):
                groups.setdefault(root if s else ("none", r), []).append(r)
            assert sum(after.values()) == len(groups)
            for g in groups.values():
                ids = [r[0] for r in g if r[0] is not None]
                assert any(after[r] and (r[0] == min(ids) if ids else True) for r in g)
        elif name == "repeated_passages":
            texts = [r[1] or "" for r in before]
            want = Counter()
            for r, t, left in zip(before, texts, without_repeats(texts, pipeline.REPEAT_WORDS), strict=True):
                want[(r[0], None if r[1] is None else left, r[2], r[3], r[4] if left == t else len(left))] += 1
            assert after == want
        else:
            tokenizers = pytest.importorskip("tokenizers")
            lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
            want = Counter()
            for r in before:
                ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, queries.END_ID]
                head = (len(ids) - 1) % 1024 + 1
                cuts = [0, *range(head, len(ids) + 1, 1024)]
                for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    want[r[0], p, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())] += 1
            assert Counter(r[:5] for r in after.elements()) == want
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4]


def test_run_is_the_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    plain = lambda df: Counter(tuple(r)[:5] for r in df.collect())
    assert plain(pipeline.run(spark, sf_dir)) == plain(docs)


CONTRACT = {
    "op2_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


def test_one_query_an_operator():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(queries.oracle_sql()) < set(queries.queries())


@pytest.mark.parametrize("start", list(CONTRACT))
def test_contracts(spark, start, sf_dir):
    (name,) = [n for n in entry.queries() if n.startswith(start)]
    for where in (SF, sf_dir):
        got = entry.queries()[name](spark, where)
        kinds = dict(got.dtypes)
        assert {k: kinds.get(k) for k in CONTRACT[start]} == CONTRACT[start]
        if start != "op5_":
            ids = Counter(r[0] for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id").collect())
            assert Counter(r[0] for r in got.select("doc_id").collect()) == ids


def test_folds(spark):
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in entry.queries()["op4_byte_cnn_quality"](spark, SF).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) and p == (s >= 0.5) for i, (h, s, p) in got.items())
    got = entry.queries()["op2_ecoc_language_id"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert spark.range(5).select(id_crc(pytest.importorskip("pyspark.sql.functions").col("id"))).collect()[3][0] == zlib.crc32(b"3")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in entry.queries()["op2_ecoc_language_id"](spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in got]) > 0.98
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in entry.queries()["op4_byte_cnn_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.93
