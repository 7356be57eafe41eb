"""A training corpus from raw documents: filter, deduplicate, mix and tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsieve.llm import exact_dedup, mixing, near_dedup, quality
from tabsieve.llm.queries import token_digests
from tabsieve.llm.stages import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and every quality rule."""
    return quality.passing(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs, shingle=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, one row per copy in the mix."""
    return token_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("byte bpe", tokens),
]

# The last stage has no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again as the next input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir).select(*COLUMNS), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
