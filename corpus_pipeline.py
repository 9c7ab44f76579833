"""The corpus pipeline: documents to packed windows, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again, and all but the last give
the columns of documents: quality rules drop rejected documents; line dedup removes repeated chunks of
lines from texts; near-dedup keeps one row, of the smallest doc_id, of each group of documents whose
five-word shingles have a Jaccard similarity of 0.8 or more (a document
that lost all its lines counts as an empty text, and of those one stays); PII replaces personal data by
its kind, as in <EMAIL>; packing gives pieces with their token ids and places in windows of 2048.
``n_chars`` follows the text.

Every stage takes null ids and texts, empty and very long texts, repeated rows and empty tables, and keeps other
columns whatever their names: null and empty texts fail the quality rules; line dedup and PII leave null texts null;
near-dedup counts a null text as an empty one; packing gives it one piece, the end id, and leaves other columns out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import line_dedup, packing, pii, quality, simhash
from gridweave.llm.shared import stored, table

ORACLE_SQL = None  # the stages need n-gram models and tokenizers; tests/llm/test_pipeline.py holds every stage against a brute-force form


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns beside doc_id and text under names that no operator gives, and how to get them back."""
    names = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(x).alias(c) for c, x in names.items()]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = aside(docs)
    return quality.judged(own, table(spark, sf_dir, "labels"), threshold=None).where("kept").select(back)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = aside(docs)
    return measured(line_dedup.deduplicated(own).select(back))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(pii.redacted(docs).select(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", distinct),
    ("PII", private),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
