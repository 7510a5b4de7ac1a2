"""A training corpus from ``documents``: rules, exact copies, near copies, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from abundex.llm import exact, mixing, rules, simhash
from abundex.llm.common import written
from abundex.llm.queries import token_digests
from abundex.session import tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    tune(spark)
    return rules.apply_policy(docs, rules.STRICT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tune(spark)
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles within three bits."""
    tune(spark)
    return simhash.drop_near_copies(docs, shingle=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the mix says."""
    tune(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of token ids and decoded text, of every document in the mix."""
    tune(spark)
    return token_digests(docs)


STAGES = [
    ("quality", quality),
    ("exact", exact_dedup),
    ("near", near_dedup),
    ("mix", mix),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
