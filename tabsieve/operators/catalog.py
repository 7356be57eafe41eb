"""Column catalog: families, indicators and controllable features, decided by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Family suffixes, the fallback family, the indicator prefix, and the prefixes of
# the features a page owner can rewrite at no cost.
FAMILY_SUFFIXES = ("url", "domain", "directory", "file", "params")
OTHER_FAMILY = "external"
INDICATOR_PREFIX = "missingindicator_"
CONTROLLABLE_PREFIXES = ("qty_", "length_", "directory_", "file_", "params_", "domain_length")
NEVER_CONTROLLABLE = "domain_spf"


def column_catalog(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """(idx, variable): one row per column, in declared order."""
    return spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "idx int, variable string")


def family(variable: Column) -> Column:
    expr = F.lit(OTHER_FAMILY)
    for suffix in reversed(FAMILY_SUFFIXES):
        expr = F.when(variable.endswith("_" + suffix), F.lit(suffix)).otherwise(expr)
    return expr


def is_indicator(variable: Column) -> Column:
    return variable.startswith(INDICATOR_PREFIX)


def is_controllable(variable: Column) -> Column:
    hit = F.lit(False)
    for prefix in CONTROLLABLE_PREFIXES:
        hit = hit | variable.startswith(prefix)
    return hit & ~is_indicator(variable) & ~variable.contains(NEVER_CONTROLLABLE)


def controllable(columns: Sequence[str]) -> list[str]:
    return [
        c for c in columns
        if c.startswith(CONTROLLABLE_PREFIXES) and not c.startswith(INDICATOR_PREFIX)
        and NEVER_CONTROLLABLE not in c
    ]


def family_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(family(F.col("variable")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def variable_pairs(catalog: DataFrame) -> DataFrame:
    """Unordered pairs of variables, earlier column first. Bounded by the schema, not by the data."""
    a = catalog.select(F.col("idx").alias("i"), F.col("variable").alias("a"))
    b = catalog.select(F.col("idx").alias("j"), F.col("variable").alias("b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j"))
