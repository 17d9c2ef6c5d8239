"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, language_id, near_dedup, pii_crf, secrets_scan, sentencepiece_bpe, substring_dedup, toxicity
from .common import in_crc_fold, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held = in_crc_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), ~held)
    return toxicity.score_column(docs, model).select(
        "doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=85)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_column(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = in_crc_fold(F.col("doc_id"), 3, 1)
    model = language_id.fit(docs, ~held)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_minhash_near_dedup, op3_secret_scan, op4_sentencepiece, op5_decontaminate,
        op6_exact_dedup, op7_pii, op8_substring_dedup, op9_language_id, op10_html_extraction,
    )
}

UPPER_TO_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({UPPER_TO_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
walk AS (SELECT a AS id, b AS r FROM links UNION SELECT walk.id, links.b FROM walk JOIN links ON walk.r = links.a),
comp AS (SELECT id, least(min(r), id) AS c FROM walk GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id""",
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
q AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared, CAST(count(*) AS DOUBLE) / n AS containment
FROM ds JOIN bs USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8::DOUBLE * n - 1e-9)""",
    "op6_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({UPPER_TO_LOWER}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t""",
}
