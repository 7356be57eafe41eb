"""Attribution for any fitted model that adds `score` and `pred`: everything is `transform` on
systematically altered rows followed by one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.operators.distribution import MAX_BUFFERS
from tabsieve.operators.metrics import confusion, rates_from_counts
from tabsieve.operators.models import BoostedModel
from tabsieve.operators.split import sample_rows

MAX_BACKGROUND = 200
ROWS_PER_BUCKET = 100_000  # rows ranked by one task; changes no result


def gain_importance(model: PipelineModel | BoostedModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(variable, importance): the tree model's impurity gain, normalised to add up to 1."""
    fitted = model.booster if isinstance(model, BoostedModel) else next(s for s in model.stages if hasattr(s, "featureImportances"))
    v = np.asarray(fitted.featureImportances.toArray())
    total = float(v.sum()) or 1.0
    return df.sparkSession.createDataFrame(
        [(f, float(x) / total) for f, x in zip(features, v, strict=True)], "variable string, importance double")


def permutation_importance(model: Model, df: DataFrame, features: Sequence[str], repeats: int = 10,
                           metric: str = "f1", seed: int = 42, key: str = "row_id", label: str = "label") -> DataFrame:
    """(variable, mean, std): drop of the metric when a column is shuffled, over repeats.

    All rows are rotated by one place in hash order, anew per repeat: every row takes the values (nulls
    too) of the next one, the last row those of the first. Ranges of the hash are ranked on their own and
    the first row of each range is handed to the range before it, so the rotation is global at any size.
    """
    n = df.count()
    buckets = max(1, n // ROWS_PER_BUCKET)
    base = rates_from_counts(confusion(model.transform(df), label)).select(F.col(metric).alias("_base"))
    spread = df.select(key, label, *features).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    h = F.xxhash64(F.lit(seed), F.col("_rep"), F.col(key))
    slot = F.shiftright(F.pmod(h, F.lit(2**40)) * F.lit(buckets), 40)
    placed = spread.withColumns({"_h": F.pmod(h, F.lit(2**40)), "_b": slot})
    w = Window.partitionBy("_rep", "_b").orderBy("_h", key)
    lowest = placed.groupBy("_rep", "_b").agg(F.min("_h").alias("_low"))
    heads = placed.join(F.broadcast(lowest), ["_rep", "_b"]).filter("_h = _low").groupBy("_rep", "_b").agg(
        F.min_by(F.struct(*features), key).alias("_row"))
    ring = Window.partitionBy("_rep").orderBy("_b")  # one row per range
    start = F.first("_row").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    handed = heads.select("_rep", "_b", F.coalesce(F.lead("_row").over(ring), start).alias("_after"))
    after = placed.withColumns({"_more": F.lead("_h").over(w).isNotNull(), **{f"_p_{c}": F.lead(c).over(w) for c in features}})
    turned = after.join(F.broadcast(handed), ["_rep", "_b"]).select(
        key, label, "_rep", *features, *[F.when(F.col("_more"), F.col(f"_p_{c}")).otherwise(F.col(f"_after.{c}")).alias(f"_p_{c}") for c in features])
    variants = turned.withColumn("_v", F.explode(F.array(*[F.lit(i) for i in range(len(features))])))
    altered = variants.select(
        key, label, "_rep", F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_v") + 1).alias("variable"),
        *[F.when(F.col("_v") == i, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(features)])
    scored = rates_from_counts(confusion(model.transform(altered), label, by=["variable", "_rep"]))
    drops = scored.join(F.broadcast(base)).withColumn("drop", F.col("_base") - F.col(metric))
    return drops.groupBy("variable").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))


def _background(df: DataFrame, features: Sequence[str], size: int, seed: int, key: str) -> Column:
    """A fixed-size array of reference rows as a literal (bounded by MAX_BACKGROUND)."""
    if size > MAX_BACKGROUND:
        raise ValueError(f"at most {MAX_BACKGROUND} background rows")
    rows = sample_rows(df.select(key, *features), size, seed, key).select(*features).collect()
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def shapley(model: Model, rows: DataFrame, background: DataFrame, features: Sequence[str], permutations: int = 8,
            background_size: int = 50, seed: int = 42, key: str = "row_id") -> DataFrame:
    """(row_id, variable, value, contribution, base, score): sampled Shapley values.

    A re-aimed estimator: feature orders and reference rows are drawn by hash. Along one order the
    row's values replace the reference row's one by one, so contributions telescope and
    base + sum of contributions equals the row's score exactly.
    """
    p = len(features)
    refs = _background(background, features, background_size, seed, key)
    placed = rows.select(key, *features).repartition(key)  # all that is shuffled: the altered rows of a row stay together
    draws = placed.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    order = F.array_sort(F.array(*[
        F.struct(F.xxhash64(F.lit(seed), F.col(key), F.col("_perm"), F.lit(i)).alias("h"), F.lit(i).alias("i"))
        for i in range(p)]))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.lit("ref"), F.col(key), F.col("_perm")), F.size(refs)).cast("int")
    base = draws.withColumns({"_o": F.transform(order, lambda s: s["i"]), "_z": F.get(refs, pick)})
    steps = base.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(p))))
    hybrid = steps.select(
        key, "_step", F.get(F.col("_o"), F.col("_step") - 1).alias("_i"), F.get(F.col("_o"), F.col("_step")).alias("_j"),
        *[F.when(F.array_position(F.col("_o"), i) <= F.col("_step"), F.col(c)).otherwise(F.col("_z")[i]).alias(c)
          for i, c in enumerate(features)])
    scored = model.transform(hybrid)
    # A score is added to the variable that was replaced last and taken off the one that is replaced next.
    share = lambda i: F.when(F.col("_i") == i, F.col("score")).when(F.col("_j") == i, -F.col("score")).otherwise(0.0)
    own = lambda c: F.max(F.when(F.col("_step") == p, F.col(c)))
    sums = scored.groupBy(key).agg(
        *[F.sum(share(i)).alias(f"_s{i}") for i in range(p)], *[own(c).alias(f"_v{i}") for i, c in enumerate(features)],
        F.count_if(F.col("_step") == 0).alias("_n"), F.sum(F.when(F.col("_step") == 0, F.col("score"))).alias("_b"), own("score").alias("_f"))
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_v{i}").cast("double").alias("value"),
                               (F.col(f"_s{i}") / F.col("_n")).alias("contribution")) for i, c in enumerate(features)])
    return sums.select(key, F.explode(cells).alias("_c"), (F.col("_b") / F.col("_n")).alias("base"), F.col("_f").alias("score")).select(
        key, "_c.variable", "_c.value", "_c.contribution", "base", "score")


def global_attribution(values: DataFrame) -> DataFrame:
    return values.groupBy("variable").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def local_explanation(values: DataFrame, row, key: str = "row_id") -> DataFrame:
    return values.filter(F.col(key) == F.lit(row))


def dependence(values: DataFrame, rows: DataFrame, features: Sequence[str], key: str = "row_id") -> DataFrame:
    """(row_id, variable, value, contribution); values that carry the row's own need no join."""
    if "value" in values.columns:
        return values.filter(F.col("variable").isin(list(features))).select(key, "variable", "value", "contribution")
    cells = rows.select(key, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        [key], list(features), "variable", "value")
    return cells.join(values.select(key, "variable", "contribution"), [key, "variable"])


def pair_interactions(model: Model, rows: DataFrame, background: DataFrame, features: Sequence[str], draws: int = 2,
                      background_size: int = 50, seed: int = 42, key: str = "row_id") -> DataFrame:
    """(a, b, mean_abs): mean |f(ij) - f(i) - f(j) + f(none)| over rows and reference rows.

    A re-aimed estimator of pairwise interaction; f(S) scores a reference row with the row's
    values in S.
    """
    p = len(features)
    refs = _background(background, features, background_size, seed, key)
    subsets = [(-1, -1)] + [(i, -1) for i in range(p)] + [(i, j) for i in range(p) for j in range(i + 1, p)]
    sets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in subsets])
    placed = rows.select(key, *features).repartition(key)  # all that is shuffled: the altered rows of a row stay together
    d = placed.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.lit("pair"), F.col(key), F.col("_draw")), F.size(refs)).cast("int")
    ex = d.withColumn("_z", F.get(refs, pick)).select("*", F.posexplode(sets).alias("_n", "_s"))
    hybrid = ex.select(
        key, "_draw", "_n",
        *[F.when((F.col("_s.i") == i) | (F.col("_s.j") == i), F.col(c)).otherwise(F.col("_z")[i]).alias(c)
          for i, c in enumerate(features)])
    # One row per (row, draw) with the scores of all sets: as columns, or as a map if they are many.
    scored = model.transform(hybrid).groupBy(key, "_draw")
    if len(subsets) <= MAX_BUFFERS:
        scored = scored.agg(*[F.max(F.when(F.col("_n") == n, F.col("score"))).alias(f"_f{n}") for n in range(len(subsets))])
        at = {s: F.col(f"_f{n}") for n, s in enumerate(subsets)}
    else:
        scored = scored.agg(F.map_from_entries(F.collect_list(F.struct("_n", "score"))).alias("_m"))
        at = {s: F.col("_m")[n] for n, s in enumerate(subsets)}
    cells = F.array(*[
        F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"),
                 F.abs(at[i, j] - at[i, -1] - at[j, -1] + at[-1, -1]).alias("gap"))
        for i, j in subsets if j >= 0])
    return scored.select(F.explode(cells).alias("_c")).groupBy("_c.a", "_c.b").agg(F.avg("_c.gap").alias("mean_abs"))
