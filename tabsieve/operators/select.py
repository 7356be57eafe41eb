"""Feature selection: variance filter, correlation pruning, embedded and wrapper selectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.profile import constancy, pearson_pairs


def variance_filter(df: DataFrame, features: Sequence[str], quasi: float | None = 0.99) -> list[str]:
    """Columns left after dropping constant and (unless quasi is None) quasi-constant ones."""
    kinds = {r["variable"]: r["kind"] for r in constancy(df, features, quasi if quasi is not None else 2.0).collect()}
    return [c for c in features if kinds[c] == "varied"]


def pruned_by_correlation(df: DataFrame, features: Sequence[str], limit: float = 0.95) -> DataFrame:
    """(variable, dropped): dropped when correlated with any earlier column, itself dropped or not."""
    pairs = pearson_pairs(df, features).filter(F.abs("r") > limit)
    hit = pairs.select(F.col("b").alias("variable")).distinct().withColumn("dropped", F.lit(True))
    names = df.sparkSession.createDataFrame([(c,) for c in features], "variable string")
    return names.join(F.broadcast(hit), "variable", "left").fillna({"dropped": False})


def prune_correlated(df: DataFrame, features: Sequence[str], limit: float = 0.95) -> list[str]:
    dropped = {r["variable"] for r in pruned_by_correlation(df, features, limit).filter("dropped").collect()}
    return [c for c in features if c not in dropped]


def _vector(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df).select(
        "features", F.col(label).cast("double").alias("label"))


def select_l1(df: DataFrame, features: Sequence[str], label: str = "label", c: float = 0.1,
              floor: float = 1e-8, max_iter: int = 100) -> list[str]:
    """L1 logistic regression with inverse penalty c (per-row penalty 1/(c n)); non-zero coefficients stay."""
    data = _vector(df, features, label).persist()
    try:
        n = data.count()
        model = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n), maxIter=max_iter,
                                   standardization=False).fit(data)
    finally:
        data.unpersist()
    w = np.abs(model.coefficients.toArray())
    return [f for f, x in zip(features, w, strict=True) if x > floor]


def at_least_median(features: Sequence[str], importance: Sequence[float]) -> list[str]:
    cut = float(np.median(importance))
    return [f for f, x in zip(features, importance, strict=True) if x >= cut]


def select_forest(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 300,
                  depth: int = 10, seed: int = 42) -> list[str]:
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(_vector(df, features, label))
    return at_least_median(features, model.featureImportances.toArray())


def select_boosted(df: DataFrame, features: Sequence[str], label: str = "label", iterations: int = 50,
                   depth: int = 5, seed: int = 42) -> list[str]:
    model = GBTClassifier(maxIter=iterations, maxDepth=depth, seed=seed).fit(_vector(df, features, label))
    return at_least_median(features, model.featureImportances.toArray())


def recursive_elimination(
    df: DataFrame, features: Sequence[str], score: Callable[[list[str]], float], label: str = "label",
    step: int = 5, smallest: int = 1, max_iter: int = 50,
) -> tuple[list[str], list[tuple[int, float]]]:
    """Drop the `step` smallest |coefficients| at a time; the size of best score wins (fewest on ties)."""
    current, history, subsets = list(features), [], {}
    while True:
        value = score(current)
        history.append((len(current), value))
        subsets[len(current)] = list(current)
        if len(current) <= smallest:
            break
        model = LogisticRegression(maxIter=max_iter).fit(_vector(df, current, label))
        drop = min(step, len(current) - smallest)
        order = np.argsort(np.abs(model.coefficients.toArray()), kind="stable")
        gone = {current[i] for i in order[:drop]}
        current = [c for c in current if c not in gone]
    best = max(history, key=lambda h: (h[1], -h[0]))[0]
    return subsets[best], history
