"""A training corpus from raw documents in five stages, counted as part of tactus.llm.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.  A stage is written to Parquet
before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tactus.llm import decontamination, exact, minhash, packing, toxicity
from tactus.llm.queries import toxicity_model
from tactus.llm.storage import staged


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return toxicity.keep_civil(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the smallest id."""
    return exact.keep_first(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the smallest id."""
    return minhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", civil), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("decontamination", clean), ("packing", packed)]

#: Tokens, sketches and segment scores aren't expressible in SQL: tests/llm/test_matching.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
