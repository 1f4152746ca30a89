"""The training-data pipeline: quality rules, language ID, SimHash near-dedup,
benchmark decontamination, packing.

Each stage takes what its predecessor kept; all but the last return the columns
of ``documents``.  ``run`` writes every stage's result as Parquet under the
shared checkpoint folder and reads it again, so that a lost executor costs one
stage's tasks at most; a stage's own intermediate tables and its predecessor's result are
deleted once its result is written.  An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quietab.llm.common import table
from quietab.llm.decontam import without_leaks
from quietab.llm.langid import keep_languages
from quietab.llm.packing import pack
from quietab.llm.quality import quality
from quietab.llm.simhash import one_of_each
from quietab.session import drop_folder, scratch, scratch_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality(docs, table(spark, sf_dir, "labels"), filter_rows=True)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_languages(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, shingle=3, max_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Learned and hashed stages that SQL cannot express; tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_folder(spark, name)
        with scratch(spark):  # what the stage writes besides its result goes with it
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return docs
