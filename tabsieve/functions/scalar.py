"""Column expressions shared by the operators. Everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_53 = float(2**53)


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num/den, or the default where the denominator is zero or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def null_if(col: str, sentinel: float) -> Column:
    c = F.col(col).cast("double")
    return F.when(c != F.lit(float(sentinel)), c)


def nan_to_null(col: str) -> Column:
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c), c)


def hash_order(seed: int | Column, *key: str) -> Column:
    """Deterministic shuffle key: the order of these hex strings replaces a random permutation."""
    seed_col = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed_col, *[F.col(k).cast("string") for k in key]))


def hash_uniform(*parts: Column) -> Column:
    """Uniform draw in [0, 1) that depends only on its inputs, never on partitioning."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)).cast("double") / F.lit(TWO_53)


def interpolate(value: Column, target: Column, effort: Column) -> Column:
    """Move a share `effort` of the way from value to target."""
    return (F.lit(1.0) - effort) * value + effort * target


def right_closed_bin(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (a, b] holding the value; the first interval also holds its left edge."""
    expr = F.when((value >= edges[0]) & (value <= edges[1]), F.lit(labels[0]))
    for lo, hi, name in zip(edges[1:-1], edges[2:], labels[1:], strict=True):
        expr = expr.when((value > lo) & (value <= hi), F.lit(name))
    return expr


def number_grid(df: DataFrame, name: str, start: float, stop: float, num: int) -> DataFrame:
    """Rows x an evenly spaced grid (both ends included), without a join."""
    step = (stop - start) / (num - 1)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(num - 1)),
        lambda i: F.round(F.lit(start) + i.cast("double") * F.lit(step), 12),
    )
    return df.select("*", F.explode(points).alias(name))


def iso_utc(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def joined_sorted(col: Column, sep: str = " / ") -> Column:
    """Aggregate: the group's strings, sorted and joined."""
    return F.concat_ws(sep, F.sort_array(F.collect_list(col)))
