"""Projection, normalisation, duplicates and contradictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.scalar import nan_to_null, null_if

HOT_SHARE = 1000  # a key is hot when it holds at least 1/HOT_SHARE of the rows


class IntegrityError(ValueError):
    """A dataset failed a declared check."""


def feature_columns(df: DataFrame, label: str, drop: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != label and c not in set(drop)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def recode_label(df: DataFrame, target: str, positive, label: str = "label") -> DataFrame:
    """Positive class = 1, whatever polarity the source uses."""
    recoded = (F.col(target) == F.lit(positive)).cast("int")
    if target == label:
        return df.withColumn(label, recoded)
    return df.withColumn(label, recoded).drop(target)


def sentinel_to_null(df: DataFrame, features: Sequence[str], sentinel: float = -1.0) -> DataFrame:
    return df.withColumns({c: null_if(c, sentinel) for c in features})


def nan_as_null(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: nan_to_null(c) for c in features})


def sentinel_conservation(df: DataFrame, features: Sequence[str], sentinel: float = -1.0) -> DataFrame:
    """One row: sentinel cells before, new nulls after, and whether they agree."""
    before = reduce(lambda a, b: a + b, [F.count_if(F.col(c) == F.lit(sentinel)) for c in features])
    nulls_raw = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in features])
    nulls_after = reduce(lambda a, b: a + b, [F.count_if(null_if(c, sentinel).isNull()) for c in features])
    return df.agg(before.alias("sentinel_cells"), (nulls_after - nulls_raw).alias("null_cells")).withColumn(
        "conserved", F.col("sentinel_cells") == F.col("null_cells")
    )


def align(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rename source columns onto a shared vocabulary: {common: source}."""
    return df.select(*keep, *[F.col(src).cast("double").alias(common) for common, src in mapping.items()])


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct key; with every projected column in the key, 'first' is immaterial."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def _label_counts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"),
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"),
    )


def duplicate_report(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Duplicates over all columns and over features only, conflict groups and rows (binary label)."""
    g = _label_counts(df, features, label)
    clash = (F.col("n1") > 0) & (F.col("n0") > 0)
    return g.agg(
        F.sum(F.greatest(F.col("n1") - 1, F.lit(0)) + F.greatest(F.col("n0") - 1, F.lit(0))).alias("dup_all"),
        F.sum(F.col("n") - 1).alias("dup_features"),
        F.count_if(clash).alias("conflict_groups"),
        F.coalesce(F.sum(F.when(clash, F.col("n"))), F.lit(0)).alias("conflict_rows"),
    )


def conflict_groups(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature combinations that occur with more than one label (NULLs compare equal)."""
    g = df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("_lo"), F.max(label).alias("_hi")
    )
    return g.filter(F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")


def _null_safe(features: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in features])


def labels_per_group(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Every row with the number of distinct labels in its feature group (`n_labels`).

    The statistic is aggregated first and looked up afterwards: keys that hold a large share of
    the rows (at most HOT_SHARE of them can exist) are served from a broadcast table, the rest
    by a shuffle join, so one group of copies never lands in a single task.
    """
    stats = df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("n_labels")
    )
    named = stats.select(*[F.col(c).alias(f"_k_{c}") for c in features], "_n", "n_labels")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    hot = (
        named.join(F.broadcast(total), F.col("_n") * HOT_SHARE >= F.col("_total"))
        .drop("_n", "_total").withColumnRenamed("n_labels", "_hot_labels")
    )
    first = df.join(F.broadcast(hot), _null_safe(features, "_k_"), "left").drop(*[f"_k_{c}" for c in features])
    served = first.filter(F.col("_hot_labels").isNotNull()).select(
        *df.columns, F.col("_hot_labels").alias("n_labels"))
    rest = first.filter(F.col("_hot_labels").isNull()).drop("_hot_labels").join(
        named.drop("_n"), _null_safe(features, "_k_")).select(*df.columns, "n_labels")
    return served.unionByName(rest)


def drop_contradictions(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Keep all rows (copies too) of the groups whose label is unanimous."""
    return labels_per_group(df, features, label).filter(F.col("n_labels") == 1).drop("n_labels")


def clean(
    df: DataFrame, features: Sequence[str], label: str, drop_conflicts: bool = True, key: str | None = None
) -> DataFrame:
    """Exact duplicates removed and, optionally, every row of contradictory groups.

    A single aggregation keyed by the features: copies collapse before the shuffle, a group's
    labels are compared in the same pass, and no row is joined back.
    """
    keep = [F.min(key).alias(key)] if key else []
    if not drop_conflicts:
        return df.groupBy(*features, label).agg(*keep) if keep else df.select(*features, label).distinct()
    g = df.groupBy(*features).agg(F.min(label).alias(label), F.max(label).alias("_hi"), *keep)
    columns = ([key] if key else []) + [*features, label]
    return g.filter(F.col(label) == F.col("_hi")).select(*columns)


def cleaning_counts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows before, rows lost to contradictions, rows lost to duplicates, rows left."""
    g = _label_counts(df, features, label)
    clash = (F.col("n1") > 0) & (F.col("n0") > 0)
    return g.agg(
        F.sum("n").alias("rows_in"),
        F.coalesce(F.sum(F.when(clash, F.col("n"))), F.lit(0)).alias("rows_conflict"),
        F.coalesce(F.sum(F.when(~clash, F.col("n") - 1)), F.lit(0)).alias("rows_duplicate"),
        F.count_if(~clash).alias("rows_out"),
    )


def verify_counts(actual: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Compare one row of counts with saved ones; reading the result fails on drift."""
    def gate(name: str, want: int) -> Column:
        got = F.col(name)
        return F.when(got == F.lit(want), got).otherwise(
            F.raise_error(F.concat(F.lit(f"{name}: expected {want}, got "), got.cast("string"))).cast("bigint"))

    return actual.select(*[gate(k, v).alias(k) for k, v in expected.items()])


def require_no_nulls(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Post-condition of imputation: raises when a feature still holds a NULL."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    left = {c: row[c] for c in features if row[c]}
    if left:
        raise IntegrityError(f"nulls left after imputation: {left}")
    return df


def fill_with_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Descriptive median fill over the whole data (exploration only, never before a split)."""
    from tabsieve.operators.distribution import exact_medians

    medians = {r["variable"]: r["median"] for r in exact_medians(df, features).collect()}
    return df.fillna({c: m for c, m in medians.items() if m is not None})


def load_stats(df: DataFrame, features: Sequence[str], label: str, rows_raw: int | Column | None = None) -> DataFrame:
    """rows, null cells, positives, negatives and imbalance ratio of a loaded dataset."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in features])
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    out = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("null_cells"), pos.alias("positives"),
                 neg.alias("negatives"))
    ratio = F.try_divide(F.greatest("positives", "negatives").cast("double"),
                         F.least("positives", "negatives").cast("double"))
    return out.withColumn("imbalance_ratio", ratio)
