"""Corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and rereads for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knnhard.llm import decontaminate, exact_dedup, langid, mixing, simhash_dedup
from knnhard.llm._common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: rejects null, empty and letterless texts, and those of
    which under three tenths of the n-grams belong to any one language."""
    return langid.keep_known(docs, langid.train(langid.training_rows(docs)), min_score=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by fingerprints, the document with the smallest doc_id stays."""
    return simhash_dedup.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds rate and copies; documents that the mix reads no time go. All clean documents stay."""
    return mixing.apply_mix(docs, mixing.domain_labels(table(spark, sf_dir, "labels")), mixing.TARGETS, whole="clean")


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: The language and mixing stages learn models, which SQL cannot express: tests hold run() against
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
