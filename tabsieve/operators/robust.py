"""Robustness: manipulated features and shifted populations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.scalar import hash_uniform, interpolate

# Effort levels of the sweep, and the length columns of the consistency rule.
EFFORTS = (0.0, 0.25, 0.5, 0.75, 1.0)
TOTAL_LENGTH, PART_LENGTHS = "length_url", ("directory_length", "file_length", "params_length")


def consistent(df: DataFrame) -> Column:
    """The total length covers the sum of its parts; NULL where the columns are not there."""
    parts = [c for c in PART_LENGTHS if c in df.columns]
    if TOTAL_LENGTH not in df.columns or not parts:
        return F.lit(None).cast("boolean")
    total = F.lit(0.0)
    for c in parts:
        total = total + F.col(c)
    return F.col(TOTAL_LENGTH) >= total


def with_efforts(df: DataFrame, efforts: Sequence[float] = EFFORTS) -> DataFrame:
    return df.withColumn("effort", F.explode(F.array(*[F.lit(float(e)) for e in efforts])))


def imitate(df: DataFrame, profile: Mapping[str, float], columns: Sequence[str]) -> DataFrame:
    """Move the columns towards a profile by the row's effort."""
    return df.withColumns({c: interpolate(F.col(c), F.lit(float(profile[c])), F.col("effort")) for c in columns})


def jitter(df: DataFrame, profile: Mapping[str, float], columns: Sequence[str], seed: int = 42,
           key: str = "row_id") -> DataFrame:
    """Control: the same magnitude in a random direction per cell, clipped at 0.

    The sign depends on (seed, column, effort, row), so it survives retries and repartitioning.
    """
    def moved(c: str) -> Column:
        sign = F.when(hash_uniform(F.lit(seed), F.lit(c), F.col("effort"), F.col(key)) < 0.5, -1.0).otherwise(1.0)
        return F.greatest(F.col(c) + F.col("effort") * sign * F.abs(F.lit(float(profile[c])) - F.col(c)), F.lit(0.0))

    return df.withColumns({c: moved(c) for c in columns})


def overwrite(df: DataFrame, profile: Mapping[str, float], columns: Sequence[str]) -> DataFrame:
    """Upper bound: every listed column takes the profile's value."""
    return df.withColumns({c: F.lit(float(profile[c])) for c in columns})


def broken_by_attack(before: DataFrame, profile: Mapping[str, float], columns: Sequence[str],
                     efforts: Sequence[float] = EFFORTS) -> DataFrame:
    """(effort, rows, consistent_before, broken, pct): rows consistent before and not after."""
    swept = with_efforts(before.withColumn("_before", consistent(before)), efforts)
    after = imitate(swept, profile, columns)
    after = after.withColumn("_after", consistent(after))
    return after.groupBy("effort").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_before").alias("consistent_before"),
        F.count_if(F.col("_before") & ~F.col("_after")).alias("broken"),
    ).withColumn("pct", F.coalesce(
        F.try_divide(F.col("broken") * 100.0, F.col("consistent_before").cast("double")), F.lit(0.0)))


def detection_by_effort(scored: DataFrame, pred: str = "pred", by: Sequence[str] = ("effort",)) -> DataFrame:
    """(effort, rows, detected, evaded, recall) of scored positives."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(pred).cast("bigint")).alias("detected"),
    ).withColumns({"evaded": F.col("rows") - F.col("detected"), "recall": F.col("detected") / F.col("rows")})
