"""From raw documents to training sequences: filter, deduplicate, decontaminate, pack."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from watchfold.llm import decontam, exact_dedup, ngram_join, packing, quality  # noqa: E402
from watchfold.llm.common import written  # noqa: E402


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted text of their language."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality.keep_good(spark, docs, trusted)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return ngram_join.keep_one(spark, docs)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of documents, with their token ids and places."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", good_text),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", clean_of_tests),
    ("packing", packed),
]

ORACLE_SQL = None  # perplexity and tokenisation have no SQL form; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
