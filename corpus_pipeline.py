"""Training text from raw documents: quality, near duplicates, benchmarks, secrets, mixture.

Every stage works on all documents that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forage.llm import automaton, jaccard_join, novelty, pareto_mix, zstd_quality
from forage.llm.frames import table
from forage.session import work_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return zstd_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of similar shingle sets connect."""
    return jaccard_join.keep_first(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of test items; texts that are mostly such passages go."""
    return automaton.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in the place of every secret."""
    return novelty.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the copies and words that the mixture takes of it; those it takes none of have 0."""
    return pareto_mix.mix(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: No SQL: the first stage compresses with trained dictionaries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
