"""Imputers and scalers as Estimator / Model pairs, so that a Pipeline refits them inside each fold.

Fitting runs aggregates whose result is a few numbers per column; the fitted model is plain
column expressions, so transforming never leaves code generation and adds no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.catalog import INDICATOR_PREFIX
from tabsieve.operators.distribution import (
    column_aggregate, exact_medians, exact_quantiles, value_histogram,
)
from tabsieve.operators.profile import binary_columns
from tabsieve.session import ensure_checkpoint_dir


def _stats(df: DataFrame) -> dict[str, dict]:
    """Collect a table with one row per variable."""
    return {r["variable"]: r.asDict() for r in df.collect()}


def impute_statistics(df: DataFrame, features: Sequence[str], strategy: str) -> DataFrame:
    """(variable, fill) for mean, median or most_frequent (smallest value on ties)."""
    if strategy == "mean":
        return column_aggregate(df, features, {"fill": lambda c: F.avg(c)}, buffers_each=2)
    if strategy == "median":
        return exact_medians(df, features).withColumnRenamed("median", "fill")
    if strategy == "most_frequent":
        hist = value_histogram(df, features).filter(F.col("value").isNotNull())
        return hist.groupBy("variable").agg(
            F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("b")
        ).select("variable", (-F.col("b.v")).alias("fill"))
    raise ValueError(f"unknown strategy {strategy!r}")


class ImputerModel(Model):
    def __init__(self, features: Sequence[str], fills: dict[str, float], indicators: Sequence[str]):
        super().__init__()
        self.features, self.fills, self.indicators = list(features), fills, list(indicators)
        self.output = self.features + [INDICATOR_PREFIX + c for c in self.indicators]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumns({
            INDICATOR_PREFIX + c: F.col(c).isNull().cast("double") for c in self.indicators
        }) if self.indicators else dataset
        return out.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c])) for c in self.features if c in self.fills
        })


class ColumnImputer(Estimator):
    """mean | median | most_frequent | constant, with indicators for columns null at fit time."""

    def __init__(self, features: Sequence[str], strategy: str = "median", indicators: bool = False,
                 constant: float = -1.0):
        super().__init__()
        self.features, self.strategy = list(features), strategy
        self.indicators, self.constant = indicators, constant

    def _fit(self, dataset: DataFrame) -> ImputerModel:
        flagged: list[str] = []
        if self.indicators:
            row = dataset.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in self.features]).first()
            flagged = [c for c in self.features if row[c]]
        if self.strategy == "constant":
            fills = {c: float(self.constant) for c in self.features}
        else:
            fitted = _stats(impute_statistics(dataset, self.features, self.strategy))
            # A column with no value at all falls back to 0, so that no NULL is left behind.
            fills = {c: float(s["fill"]) for c, s in fitted.items() if s["fill"] is not None}
            fills = {c: fills.get(c, 0.0) for c in self.features}
        return ImputerModel(self.features, fills, flagged)


class ScalerModel(Model):
    """x -> (x - shift) / scale per column; untouched columns pass through."""

    def __init__(self, params: dict[str, tuple[float, float]]):
        super().__init__()
        self.shifts = params

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            c: (F.col(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in self.shifts.items()
        })


def scale_statistics(df: DataFrame, features: Sequence[str], method: str) -> DataFrame:
    """(variable, shift, scale); a zero scale becomes 1, so constant columns stay finite."""
    if method == "standard":
        st = column_aggregate(df, features, {"shift": lambda c: F.avg(c), "scale": lambda c: F.stddev_pop(c)}, 3)
    elif method == "minmax":
        st = column_aggregate(df, features, {"shift": lambda c: F.min(c), "hi": lambda c: F.max(c)}).select(
            "variable", F.col("shift").cast("double").alias("shift"), (F.col("hi") - F.col("shift")).alias("scale"))
    elif method == "maxabs":
        st = column_aggregate(df, features, {"scale": lambda c: F.max(F.abs(c))}).select(
            "variable", F.lit(0.0).alias("shift"), "scale")
    elif method == "robust":
        q = exact_quantiles(df, features, [0.25, 0.5, 0.75])
        pick = lambda p: F.max(F.when(F.col("p") == p, F.col("q")))
        st = q.groupBy("variable").agg(pick(0.5).alias("shift"), (pick(0.75) - pick(0.25)).alias("scale"))
    else:
        raise ValueError(f"unknown scaler {method!r}")
    return st.withColumn("scale", F.when((F.col("scale") == 0) | F.col("scale").isNull(), 1.0)
                         .otherwise(F.col("scale").cast("double")))


class ColumnScaler(Estimator):
    """none | standard | minmax | robust | maxabs | yeo_johnson, on continuous columns only.

    Columns whose values stay within {0, 1} (missing indicators included) pass through.
    """

    def __init__(self, features: Sequence[str], method: str = "standard", skip_binary: bool = True):
        super().__init__()
        self.features, self.method, self.skip_binary = list(features), method, skip_binary

    def _fit(self, dataset: DataFrame) -> Model:
        if self.method == "none":
            return ScalerModel({})
        skip = set(binary_columns(dataset, self.features)) if self.skip_binary else set()
        cols = [c for c in self.features if c not in skip]
        if not cols:
            return ScalerModel({})
        if self.method == "yeo_johnson":
            return fit_yeo_johnson(dataset, cols)
        st = _stats(scale_statistics(dataset, cols, self.method))
        return ScalerModel({c: (float(s["shift"] or 0.0), float(s["scale"])) for c, s in st.items()})


# ---- Yeo-Johnson -----------------------------------------------------------------------------

def yeo_johnson(x: F.Column, lam: F.Column) -> F.Column:
    pos = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    two = F.lit(2.0) - lam
    neg = F.when(F.abs(two) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(-x + 1, two) - 1) / two)
    return F.when(x >= 0, pos).otherwise(neg)


class YeoJohnsonModel(Model):
    def __init__(self, lambdas: dict[str, float], moments: dict[str, tuple[float, float]]):
        super().__init__()
        self.lambdas, self.moments = lambdas, moments

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            c: (yeo_johnson(F.col(c).cast("double"), F.lit(lam)) - F.lit(self.moments[c][0])) / F.lit(self.moments[c][1])
            for c, lam in self.lambdas.items()
        })


def fit_yeo_johnson(df: DataFrame, features: Sequence[str], low: float = -2.0, high: float = 4.0,
                    points: int = 9, rounds: int = 4) -> YeoJohnsonModel:
    """Maximum-likelihood lambda per column by successive grid refinement.

    Each round is one aggregate over the value histogram for all columns and candidates; the
    driver only narrows an interval per column between rounds.
    """
    hist = value_histogram(df, features).filter(F.col("value").isNotNull()).persist()
    interval = {c: (low, high) for c in features}
    best = {c: 1.0 for c in features}
    moments = {c: (0.0, 1.0) for c in features}
    spark = df.sparkSession
    try:
        for _ in range(rounds):
            grid = [(c, a + (b - a) * i / (points - 1)) for c, (a, b) in interval.items() for i in range(points)]
            cand = spark.createDataFrame(grid, "variable string, lam double")
            y = yeo_johnson(F.col("value"), F.col("lam"))
            logs = F.signum("value") * F.log1p(F.abs("value"))
            s = hist.join(F.broadcast(cand), "variable").select("variable", "lam", "n", y.alias("y"), logs.alias("g"))
            w = F.col("n").cast("double")
            agg = s.groupBy("variable", "lam").agg(
                F.sum(w).alias("t"), F.sum(w * F.col("y")).alias("s1"),
                F.sum(w * F.col("y") * F.col("y")).alias("s2"), F.sum(w * F.col("g")).alias("sg"))
            seen: dict[str, list] = {}
            for r in agg.collect():  # columns x candidates
                mean = r["s1"] / r["t"]
                var = r["s2"] / r["t"] - mean * mean
                seen.setdefault(r["variable"], []).append((r["lam"], mean, var, r["sg"], r["t"]))
            for c, rows in seen.items():
                scored = [(-t / 2 * math.log(var) + (lam - 1) * sg, lam, mean, var)
                          for lam, mean, var, sg, t in rows if var > 1e-300 and math.isfinite(var)]
                if not scored:
                    continue
                _, lam, mean, var = max(scored)
                best[c], moments[c] = lam, (mean, math.sqrt(var))
                half = (interval[c][1] - interval[c][0]) / (points - 1)
                interval[c] = (lam - half, lam + half)
    finally:
        hist.unpersist()
    return YeoJohnsonModel(best, moments)


# ---- null-aware binning ----------------------------------------------------------------------

class NullBinModel(Model):
    def __init__(self, edges: dict[str, list[float]]):
        super().__init__()
        self.edges = edges

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def code(c: str, e: list[float]):
            arr = F.array(*[F.lit(x) for x in e]) if e else F.array().cast("array<double>")
            return F.when(F.col(c).isNull(), 0.0).otherwise(
                (F.size(F.filter(arr, lambda x: x < F.col(c))) + 1).cast("double"))

        return dataset.withColumns({c: code(c, e) for c, e in self.edges.items()})


class NullBinEncoder(Estimator):
    """No imputation: values become quantile-bin codes and NULL is a bin of its own (0), so a tree
    can send missing rows either way."""

    def __init__(self, features: Sequence[str], bins: int = 32):
        super().__init__()
        self.features, self.bins = list(features), bins

    def _fit(self, dataset: DataFrame) -> NullBinModel:
        q = exact_quantiles(dataset, self.features, [i / self.bins for i in range(1, self.bins)])
        edges = {c: [] for c in self.features}
        for r in q.groupBy("variable").agg(F.array_sort(F.collect_set("q")).alias("e")).collect():
            edges[r["variable"]] = r["e"]
        return NullBinModel(edges)


# ---- iterative imputation --------------------------------------------------------------------

class IterativeImputerModel(Model):
    """Applies the fitted chain of regressions batch by batch, so the plan does not grow with it."""

    def __init__(self, features: Sequence[str], start: dict[str, float],
                 steps: list[tuple[int, np.ndarray, float]]):
        super().__init__()
        self.features, self.start, self.steps = list(features), start, steps

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, steps = self.features, self.steps
        fill = np.array([self.start[c] for c in features])
        cast = dataset.withColumns({c: F.col(c).cast("double") for c in features})

        def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf[features].to_numpy(dtype="float64", na_value=np.nan)
                miss = np.isnan(x)
                x = np.where(miss, fill, x)
                for t, coef, intercept in steps:
                    rows = miss[:, t]
                    if rows.any():
                        x[rows, t] = x[rows] @ coef + intercept
                pdf[features] = x
                yield pdf

        return cast.mapInPandas(chain, cast.schema)


def _pattern_sums(features: Sequence[str], start: np.ndarray) -> Callable:
    """Per pattern of missing columns the sums of z z', z being (values - start, 1) with 0 for what is missing."""
    p = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in features]
            x = np.stack(columns, axis=1).astype("float64") - start
            miss = np.isnan(x)
            z = np.concatenate([np.where(miss, 0.0, x), np.ones((len(x), 1))], axis=1)
            patterns, of = np.unique(miss, axis=0, return_inverse=True)
            of = of.reshape(-1)
            for i, pattern in enumerate(patterns):
                part = z[of == i]
                name = np.packbits(pattern).tobytes()
                held[name] = held.get(name, 0.0) + part.T @ part
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array([g.reshape(-1).tolist() for g in held.values()], pa.list_(pa.float64()))],
                names=["pattern", "gram"])

    def total(table: pa.Table) -> pa.Table:
        flat = table["gram"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, (p + 1) ** 2)
        return pa.table({"pattern": table["pattern"].slice(0, 1), "gram": pa.array([flat.sum(0).tolist()], pa.list_(pa.float64()))})

    return run, total


class IterativeImputer(Estimator):
    """Round-robin regression: every column with nulls is predicted from the others, in turn.

    A regression needs sums of products of the current fill over the rows where its target is observed. Rows that miss
    the same columns are filled by the same linear maps, so the sums of such a pattern follow each step by a small matrix
    product: one scan gathers them for all patterns, and every round is solved from them without another look at the
    table. A ridge term keeps collinear columns stable. Columns without any value are filled with 0 and not predicted.

    Patterns are few where columns are missing together; if their sums pass `memory` bytes, each step gathers its sums
    from the rows instead (one job a round and column), with the same result.
    """

    def __init__(self, features: Sequence[str], max_iter: int = 10, ridge: float = 1e-6, memory: int = 256 << 20):
        super().__init__()
        self.features, self.max_iter, self.ridge, self.memory = list(features), max_iter, ridge, memory

    def _fit(self, dataset: DataFrame) -> IterativeImputerModel:
        f, p = self.features, len(self.features)
        cells = dataset.select(*[F.col(c).cast("double").alias(c) for c in f])
        known = cells.agg(*[F.avg(c).alias(c) for c in f], *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in f]).first()
        start = {c: float(known[c] or 0.0) for c in f}
        targets = sorted([c for c in f if known[f"{c}_nulls"] and known[c] is not None], key=lambda c: known[f"{c}_nulls"])
        if not targets or not self.max_iter:
            return IterativeImputerModel(f, start, [])
        shift = np.array([start[c] for c in f])
        gather, total = _pattern_sums(f, shift)
        ensure_checkpoint_dir(dataset.sparkSession)
        parts = cells.mapInArrow(gather, "pattern binary, gram array<double>").groupBy("pattern").applyInArrow(
            total, "pattern binary, gram array<double>").checkpoint()
        if parts.count() * (p + 1) ** 2 * 8 > self.memory:
            return self._by_rows(cells, start, targets)
        rows = parts.collect()
        grams = np.array([r["gram"] for r in rows]).reshape(-1, p + 1, p + 1)
        missing = np.array([np.unpackbits(np.frombuffer(r["pattern"], dtype=np.uint8))[:p] for r in rows], dtype=bool)
        steps = []
        for _ in range(self.max_iter):
            for target in targets:
                t = f.index(target)
                coef, shifted = self._solve(grams[~missing[:, t]].sum(0), t)
                move = np.eye(p + 1)
                move[t] = [*coef, shifted]
                grams[missing[:, t]] = move @ grams[missing[:, t]] @ move.T
                steps.append((t, coef, float(shifted + shift[t] - coef @ shift)))
        return IterativeImputerModel(f, start, steps)

    def _solve(self, gram: np.ndarray, t: int) -> tuple[np.ndarray, float]:
        """Coefficients (0 for the target itself) and intercept of one regression from its sums of products."""
        n, mean = gram[-1, -1], gram[-1, :-1] / gram[-1, -1]
        cov = gram[:-1, :-1] / n - np.outer(mean, mean)
        rest = [i for i in range(len(mean)) if i != t]
        a = cov[np.ix_(rest, rest)]
        scale = float(np.trace(a)) / max(1, len(rest)) or 1.0
        coef = np.zeros(len(mean))
        coef[rest] = np.linalg.solve(a + self.ridge * scale * np.eye(len(rest)), cov[rest, t])
        return coef, float(mean[t] - mean @ coef)

    def _by_rows(self, cells: DataFrame, start: dict[str, float], targets: Sequence[str]) -> IterativeImputerModel:
        f = self.features
        shift = np.array([start[c] for c in f])
        gather, total = _pattern_sums(f, shift)
        observed = cells.select(*f, *[F.col(c).isNotNull().alias(f"_obs_{c}") for c in targets])
        steps: list[tuple[int, np.ndarray, float]] = []
        for _ in range(self.max_iter):
            for target in targets:
                t = f.index(target)
                current = IterativeImputerModel(f, start, steps).transform(observed).filter(F.col(f"_obs_{target}")).select(*f)
                gram = current.mapInArrow(gather, "pattern binary, gram array<double>").groupBy("pattern").applyInArrow(
                    total, "pattern binary, gram array<double>").first()["gram"]
                coef, shifted = self._solve(np.array(gram).reshape(len(f) + 1, -1), t)
                steps = [*steps, (t, coef, float(shifted + shift[t] - coef @ shift))]
        return IterativeImputerModel(f, start, steps)


class DropColumns(Transformer):
    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.columns)


def assembled_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    arr = vector_to_array(vector)
    return df.withColumns({n: arr[i] for i, n in enumerate(names)})


