"""The queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.byte_cnn import fit_quality_cnn, score_quality
from sievelake.llm.common import checkpointed, documents, remove_path, scratch_path
from sievelake.llm.exact_dedup import exact_dedup
from sievelake.llm.labelled import id_crc
from sievelake.llm.language_id import fit_languages, language_id
from sievelake.llm.license_scan import license_scan, license_sql
from sievelake.llm.minhash import near_duplicates
from sievelake.llm.numpy_bpe import encoded_digests
from sievelake.llm.packing import pack
from sievelake.llm.quality_rules import quality_rules
from sievelake.llm.suffix_dedup import repeat_digests
from sievelake.llm.token_files import read_token_files, token_digests, write_token_files

Query = Callable[[SparkSession, str], DataFrame]


END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    told = language_id(docs, fit_languages(docs, ~F.coalesce(held_out, F.lit(False))))
    return told.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = fit_quality_cnn(docs, labels, id_crc(F.col("labelled")) % 3 != 1)
    return score_quality(docs, net).select("doc_id", F.coalesce(id_crc(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_gbt_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch_path(spark, "token-files")
    try:
        write_token_files(documents(spark, sf_dir), to, tokenizer_path("word_bpe_49k.json"), END_ID)
        return checkpointed(token_digests(read_token_files(spark, to)))
    finally:
        remove_path(spark, to)


def op5_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), END_ID)


def op10_numpy_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op7_two_stage_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir), size=400, with_text=True)


#: Every window by its digest; covered bytes as runs; what lies between them, and its characters that are whole.
OP7_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(b[i:i + 399]) AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
hit AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
edge AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS new FROM hit),
run AS (SELECT r, i, sum(new::INTEGER) OVER (PARTITION BY r ORDER BY i) AS g FROM edge),
span AS MATERIALIZED (SELECT r, min(i) AS s, max(i) + 399 AS e FROM run GROUP BY r, g),
cut AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) + 1 AS f FROM span
        UNION ALL SELECT r, octet_length(b) + 1, NULL, coalesce((SELECT max(e) FROM span WHERE span.r = d.r), 0) + 1 FROM d),
piece AS (SELECT r, s, e, CASE WHEN f < s THEN hex(b[f:s - 1]) ELSE '' END AS h FROM cut JOIN d USING (r)),
kept AS (SELECT r, CAST(coalesce(sum(e - s + 1), 0) AS BIGINT) AS n_removed, count(e) AS n_spans, string_agg(h, '' ORDER BY s) AS h,
         string_agg(regexp_replace(regexp_replace(h, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){0,2})$', ''), '' ORDER BY s) AS t FROM piece GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, n_removed, n_spans, sha256(unhex(h)) AS kept_sha256, decode(unhex(t)) AS text FROM kept JOIN d USING (r)
"""


def op8_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


_QUERIES = (
    op1_license_sentence_rules, op2_ecoc_language_id, op3_token_files, op4_byte_cnn_quality, op5_linear_grouping_packing,
    op6_odd_sketch_minhash, op7_two_stage_suffix_dedup, op8_patricia_exact_dedup, op9_gbt_quality_rules, op10_numpy_bpe,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_sentence_rules": license_sql(), "op6_odd_sketch_minhash": OP6_SQL, "op7_two_stage_suffix_dedup": OP7_SQL, "op8_patricia_exact_dedup": OP8_SQL}
