"""Corpus pipeline: quality rules, quality classifier, exact dedup, near-dedup, best-fit packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import best_fit_packing, exact_dedup, near_texts, quality_gam, quality_rules
from deltaloom.llm.common import lasting, table, table_if_any

# Every stage takes null and repeated ids, null, empty and very long texts and broken UTF-8, further columns and empty tables; what it does with them
# is stated by the operator that it calls.


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The rules leave hardly any bad document to learn from, so the model learns from all labelled documents. A stage may
    # be given documents that the folder doesn't hold; where it has no such table, the model learns from those given.
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"), table_if_any(spark, sf_dir, "documents"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.keep_one(docs)  # the wide form of op6: five-word shingles, similarity of 0.8 or more


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the fingerprints and the packing have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's output is written, what lies before it is deleted; only the lengths to be packed are left behind."""

    def kept() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = lasting(spark, name, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        return docs

    def packed() -> DataFrame:
        return STAGES[-1][1](spark, kept(), sf_dir)

    return lasting(spark, STAGES[-1][0], packed)
