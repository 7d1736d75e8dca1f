"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's ``docs``.  All but the last return the
columns of ``documents``; the last returns the packed pieces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import exact_dedup, language_id, mixing, packing, queries, simhash
from tokenloom.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go."""
    return language_id.keep_identified(docs, min_score=0.0)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest id stays."""
    return simhash.keep_one_of_each(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("language_id", identify_language), ("exact_dedup", remove_exact_copies),
          ("simhash_near_dedup", remove_near_copies), ("source_mixing", mix_sources),
          ("best_fit_packing", pack_sequences)]

#: Language ID and tokenisation are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
