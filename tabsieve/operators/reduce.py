"""Projections: principal components, linear discriminant, Nystroem kernel features.

Only p x p moments (p = number of columns) and a fixed number of landmarks ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.split import sample_rows

MAX_LANDMARKS = 2000


def moments(df: DataFrame, features: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, population covariance) of the columns, tree-aggregated on the executors."""
    vec = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df).select("_v")
    row = vec.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")).first()["s"]
    n = float(row["count"])
    mean, var = row["mean"].toArray(), row["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)
    corr = np.nan_to_num(Correlation.corr(vec, "_v").head()[0].toArray(), nan=0.0)
    np.fill_diagonal(corr, 1.0)
    sd = np.sqrt(np.maximum(var, 0.0))
    return n, mean, corr * np.outer(sd, sd)


class PrincipalComponents(Estimator):
    """Centred PCA on an assembled vector: a number of components or a share of variance to keep."""

    def __init__(self, input_col: str = "features", output_col: str = "pca", k: int | None = None,
                 variance: float | None = 0.95):
        super().__init__()
        self.input_col, self.output_col, self.k, self.variance = input_col, output_col, k, variance

    def _fit(self, dataset: DataFrame) -> PrincipalComponentsModel:
        centre = StandardScaler(withMean=True, withStd=False, inputCol=self.input_col,
                                outputCol="_centred").fit(dataset)
        p = centre.mean.size
        model = PCA(k=self.k or p, inputCol="_centred", outputCol="_pca").fit(centre.transform(dataset))
        share = np.asarray(model.explainedVariance.toArray())
        keep = self.k or int(np.searchsorted(np.cumsum(share), self.variance - 1e-12) + 1)
        return PrincipalComponentsModel(centre, model, min(keep, p), share, self.output_col)


class PrincipalComponentsModel(Model):
    def __init__(self, centre, pca, keep: int, explained: np.ndarray, output_col: str):
        super().__init__()
        self.centre, self.pca, self.keep, self.explained, self.output_col = centre, pca, keep, explained, output_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        full = self.pca.transform(self.centre.transform(dataset))
        cut = VectorSlicer(inputCol="_pca", outputCol=self.output_col, indices=list(range(self.keep)))
        return cut.transform(full).drop("_centred", "_pca")


class LinearDiscriminant(Estimator):
    """Two-class linear discriminant: class means and pooled covariance, then one p x p solve.

    The transform adds the one-dimensional projection, the posterior score and the prediction.
    """

    def __init__(self, features: Sequence[str], label: str = "label", ridge: float = 1e-9):
        super().__init__()
        self.features, self.label, self.ridge = list(features), label, ridge

    def _fit(self, dataset: DataFrame) -> LinearDiscriminantModel:
        parts = [moments(dataset.filter(F.col(self.label) == y), self.features) for y in (0, 1)]
        (n0, m0, c0), (n1, m1, c1) = parts
        pooled = (n0 * c0 + n1 * c1) / (n0 + n1)
        scale = float(np.trace(pooled)) / len(self.features) or 1.0
        w = np.linalg.solve(pooled + self.ridge * scale * np.eye(len(m0)), m1 - m0)
        b = float(-0.5 * (m0 + m1) @ w + np.log(n1 / n0))
        return LinearDiscriminantModel(self.features, w, b)


class LinearDiscriminantModel(Model):
    def __init__(self, features: Sequence[str], weights: np.ndarray, intercept: float):
        super().__init__()
        self.features, self.weights, self.intercept = list(features), weights, intercept

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights, strict=True):
            z = z + F.col(c) * F.lit(float(w))
        out = dataset.withColumn("lda", z)
        return out.withColumn("score", 1.0 / (1.0 + F.exp(-F.col("lda")))).withColumn(
            "prediction", (F.col("lda") > 0).cast("double"))


class Nystroem(Estimator):
    """RBF kernel features through landmark rows: k(x, L) K(L, L)^(-1/2).

    Landmarks are a hash-ordered sample of fixed size, so the broadcast never grows with the data.
    """

    def __init__(self, features: Sequence[str], output_col: str = "kernel", components: int = 300,
                 gamma: float | None = None, seed: int = 42, key: str = "row_id"):
        super().__init__()
        if components > MAX_LANDMARKS:
            raise ValueError(f"at most {MAX_LANDMARKS} landmarks are broadcast")
        self.features, self.output_col, self.components = list(features), output_col, components
        self.gamma, self.seed, self.key = gamma, seed, key

    def _fit(self, dataset: DataFrame) -> NystroemModel:
        rows = sample_rows(dataset.select(self.key, *self.features), self.components, self.seed, self.key)
        marks = rows.orderBy(self.key).select(*self.features).toPandas().to_numpy(dtype="float64")
        gamma = self.gamma or 1.0 / len(self.features)
        sq = (marks**2).sum(1)
        kernel = np.exp(-gamma * np.maximum(sq[:, None] + sq[None, :] - 2 * marks @ marks.T, 0.0))
        u, s, vt = np.linalg.svd(kernel)
        root = (u / np.sqrt(np.maximum(s, 1e-12))) @ vt
        return NystroemModel(self.features, self.output_col, marks, root, gamma)


class NystroemModel(Model):
    def __init__(self, features, output_col, marks, root, gamma):
        super().__init__()
        self.features, self.output_col, self.marks, self.root, self.gamma = features, output_col, marks, root, gamma

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        shared = dataset.sparkSession.sparkContext.broadcast((self.marks, self.root))
        gamma = self.gamma

        @F.pandas_udf("array<double>")
        def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            marks, root = shared.value
            sq = (marks**2).sum(1)
            for v in batches:
                x = np.array(v.tolist(), dtype="float64").reshape(len(v), marks.shape[1])
                d = np.maximum((x**2).sum(1)[:, None] + sq[None, :] - 2 * x @ marks.T, 0.0)
                yield pd.Series(list(np.exp(-gamma * d) @ root))

        arr = F.array(*[F.col(c).cast("double") for c in self.features])
        return dataset.withColumn(self.output_col, array_to_vector(kernel(arr)))
