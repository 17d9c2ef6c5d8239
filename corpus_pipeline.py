"""Corpus pipeline: language ID, exact dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; what it returns is written as Parquet and read again as the next one's
``docs``. All stages but the last return the columns of ``documents``.

Stages decide on rows, not on ids: a row that shares its ``doc_id`` with another
text, or has none, is judged by its own text. Of equal texts the largest id stays,
and rows without an id only if none has one. Rows equal in id and text are one
document: they stay or go together. Extra columns are dropped, a missing table is
an error, an empty one gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, exact_dedup, language_id, near_dedup, sentencepiece_bpe
from lumenfold.llm.common import read, save, with_row_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "_lumenfold_row"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the model rejects go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    return language_id.identify(docs.select(*COLUMNS), model).where(~F.col("lang_rejected")).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.kept_rows(docs.select(*COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    rows = with_row_ids(docs.select(*COLUMNS), ROW)
    gone = near_dedup.near_dedup(rows.select(F.col(ROW).alias("doc_id"), "text"), words=5, percent=80).where("NOT kept").select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(gone, ROW, "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    rows = with_row_ids(docs.select(*COLUMNS), ROW)
    gone = decontaminate.contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(gone, ROW, "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return sentencepiece_bpe.encode_column(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("sentencepiece", tokens),
]
#: A trained language model and a tokenizer are not SQL; tests/llm/test_pipeline.py holds each stage and ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
