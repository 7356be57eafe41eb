"""Classifier registry: name -> factory of an estimator that adds `score` and `pred`.

Every estimator reads the given feature columns and a binary label column. Tree boosters of
different brands map onto the one histogram-based booster Spark ships, with presets in their
spirit; the randomised-trees entry is an approximation and says so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.scalar import hash_uniform
from tabsieve.operators.reduce import LinearDiscriminant, Nystroem

LABEL, WEIGHT = "label", "weight"


class Predictions(Transformer):
    """Common output: `score` (probability or margin) and `pred` (0/1); the model's own columns go."""

    def __init__(self, source: str = "probability"):
        super().__init__()
        self.source = source

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.source in ("probability", "rawPrediction"):
            score = vector_to_array(self.source)[1]
            if self.source == "rawPrediction":
                score = 1.0 / (1.0 + F.exp(-score))  # a monotone map of the margin into (0, 1)
        else:
            score = F.col(self.source)
        out = dataset.withColumns({"score": score, "pred": F.col("prediction").cast("int")})
        return out.drop("features", "rawPrediction", "probability", "prediction", "lda", "kernel")


class LinearScores(Model):
    """A fitted linear classifier as a plain expression of its columns, or of one vector column."""

    def __init__(self, inputs: Sequence[str] | str, weights: Sequence[float], intercept: float):
        super().__init__()
        self.inputs, self.weights, self.intercept = inputs, [float(w) for w in weights], float(intercept)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = [F.lit(x) for x in self.weights]
        if isinstance(self.inputs, str):
            terms = F.zip_with(vector_to_array(self.inputs), F.array(*w), lambda a, b: a * b)
            z = F.aggregate(terms, F.lit(self.intercept), lambda s, t: s + t)
        else:
            z = F.lit(self.intercept)
            for c, x in zip(self.inputs, w, strict=True):
                z = z + F.col(c).cast("double") * x
        out = dataset.withColumn("_margin", z)
        return out.withColumns({"score": 1.0 / (1.0 + F.exp(-F.col("_margin"))), "pred": (F.col("_margin") > 0).cast("int")}).drop("_margin")


class Linear(Estimator):
    """Fits a Spark ML linear classifier; only its coefficients enter the plan of a transform."""

    def __init__(self, classifier: Estimator, inputs: Sequence[str] | str):
        super().__init__()
        self.classifier, self.inputs = classifier, inputs if isinstance(inputs, str) else list(inputs)

    def _fit(self, dataset: DataFrame) -> LinearScores:
        if not isinstance(self.inputs, str):
            dataset = VectorAssembler(inputCols=self.inputs, outputCol="features").transform(dataset)
        model = self.classifier.fit(dataset)
        return LinearScores(self.inputs, model.coefficients.toArray(), model.intercept)


class GaussianScores(Model):
    """A fitted Gaussian naive Bayes model as a plain expression."""

    def __init__(self, inputs: Sequence[str], priors: Sequence[float], means, variances):
        super().__init__()
        self.inputs, self.priors, self.means, self.variances = list(inputs), priors, means, variances

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = F.lit(float(self.priors[1] - self.priors[0]))
        for i, c in enumerate(self.inputs):
            for y, sign in ((1, 1.0), (0, -1.0)):
                m, v = float(self.means[y][i]), float(self.variances[y][i])
                gap = F.col(c).cast("double") - F.lit(m)
                z = z - F.lit(sign) * (F.lit(0.5 * math.log(v)) + gap * gap / F.lit(2 * v))
        out = dataset.withColumn("_margin", z)
        return out.withColumns({"score": 1.0 / (1.0 + F.exp(-F.col("_margin"))), "pred": (F.col("_margin") > 0).cast("int")}).drop("_margin")


class GaussianBayes(Estimator):
    def __init__(self, classifier: NaiveBayes, inputs: Sequence[str]):
        super().__init__()
        self.classifier, self.inputs = classifier, list(inputs)

    def _fit(self, dataset: DataFrame) -> GaussianScores:
        model = self.classifier.fit(VectorAssembler(inputCols=self.inputs, outputCol="features").transform(dataset))
        return GaussianScores(self.inputs, model.pi.toArray(), model.theta.toArray(), model.sigma.toArray())


class ConstantModel(Model):
    """Majority class, or a hash-drawn class with the training prevalence."""

    def __init__(self, prevalence: float, stratified: bool, seed: int, key: str):
        super().__init__()
        self.prevalence, self.stratified, self.seed, self.key = prevalence, stratified, seed, key

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.stratified:
            draw = (hash_uniform(F.lit(self.seed), F.col(self.key)) < self.prevalence).cast("int")
            return dataset.withColumns({"pred": draw, "score": draw.cast("double")})
        return dataset.withColumns({
            "pred": F.lit(int(self.prevalence > 0.5)), "score": F.lit(float(self.prevalence > 0.5))})


class Dummy(Estimator):
    def __init__(self, stratified: bool = False, seed: int = 42, key: str = "row_id"):
        super().__init__()
        self.stratified, self.seed, self.key = stratified, seed, key

    def _fit(self, dataset: DataFrame) -> ConstantModel:
        share = dataset.agg(F.avg(F.col(LABEL).cast("double"))).first()[0]
        return ConstantModel(float(share or 0.0), self.stratified, self.seed, self.key)


def on_columns(classifier: Estimator, features: Sequence[str], source: str = "probability") -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), classifier,
                            Predictions(source)])


def _weighted(classifier, weighted: bool):
    return classifier.setWeightCol(WEIGHT) if weighted else classifier


Factory = Callable[..., Estimator]


def logistic(features, weighted=False, max_iter=100, reg=0.0, **kw) -> Estimator:
    return Linear(_weighted(LogisticRegression(maxIter=max_iter, regParam=reg, **kw), weighted), features)


def sgd_logistic(features, weighted=False, alpha=1e-4, max_iter=20) -> Estimator:
    """Log-loss with the small L2 penalty of the stochastic solver, a few quasi-Newton passes."""
    return logistic(features, weighted, max_iter=max_iter, reg=alpha)


def linear_svm(features, weighted=False, max_iter=100, reg=0.0) -> Estimator:
    return Linear(_weighted(LinearSVC(maxIter=max_iter, regParam=reg), weighted), features)


def discriminant(features, weighted=False) -> Estimator:
    return Pipeline(stages=[LinearDiscriminant(features), Predictions("score")])


def nystroem_svm(features, weighted=False, components=300, gamma=None, seed=42, max_iter=50) -> Estimator:
    svm = _weighted(LinearSVC(featuresCol="kernel", maxIter=max_iter), weighted)
    return Pipeline(stages=[Nystroem(features, "kernel", components, gamma, seed), Linear(svm, "kernel")])


def gaussian_nb(features, weighted=False) -> Estimator:
    return GaussianBayes(_weighted(NaiveBayes(modelType="gaussian"), weighted), features)


class Perceptron(Estimator):
    """A perceptron that stops early: fits of `every` iterations go on from the last weights until the accuracy on a slice
    of the rows, picked by a hash of their features, has not grown by `tol` for `patience` fits or `max_iter` is reached.
    The best weights stay. Without rows in the slice nothing stops it."""

    def __init__(self, inputs: Sequence[str], hidden: Sequence[int] = (100,), max_iter: int = 200, seed: int = 42, every: int = 10,
                 patience: int = 2, tol: float = 1e-4, share: float = 0.1):
        super().__init__()
        self.inputs, self.hidden, self.max_iter, self.seed = list(inputs), list(hidden), max_iter, seed
        self.every, self.patience, self.tol, self.share = every, patience, tol, share

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        assembler = VectorAssembler(inputCols=self.inputs, outputCol="features")
        held = hash_uniform(F.lit(self.seed), *[F.col(c) for c in self.inputs]) < self.share
        table = assembler.transform(dataset).select("features", LABEL, held.alias("_held")).persist()
        try:
            train, valid = table.filter("NOT _held"), table.filter("_held")
            best, top, stale, done, weights = None, -1.0, 0, 0, None
            while done < self.max_iter and stale < self.patience:
                step = min(self.every, self.max_iter - done)
                net = MultilayerPerceptronClassifier(layers=[len(self.inputs), *self.hidden, 2], maxIter=step, seed=self.seed)
                model = (net.setInitialWeights(weights) if weights is not None else net).fit(train)
                weights, done = model.weights, done + step
                right = model.transform(valid).agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]
                if right is None or right > top + self.tol:
                    best, top, stale = model, right if right is not None else top, 0
                else:
                    stale += 1
        finally:
            table.unpersist()
        fitted = PipelineModel([assembler, best, Predictions()])
        fitted.iterations = done
        return fitted


def perceptron(features, weighted=False, hidden=(100,), max_iter=200, seed=42) -> Estimator:
    if weighted:
        raise ValueError("the perceptron takes no row weights")
    return Perceptron(features, hidden, max_iter, seed)


def tree(features, weighted=False, depth=20, seed=42, **kw) -> Estimator:
    return on_columns(_weighted(DecisionTreeClassifier(maxDepth=depth, seed=seed, **kw), weighted), features)


def forest(features, weighted=False, trees=300, depth=12, seed=42, **kw) -> Estimator:
    return on_columns(_weighted(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **kw), weighted), features)


def random_trees(features, weighted=False, trees=300, depth=12, seed=42) -> Estimator:
    """Approximation of extremely randomised trees: no bootstrap and very coarse split candidates."""
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False, maxBins=8,
                                featureSubsetStrategy="sqrt")
    return on_columns(_weighted(rf, weighted), features)


class BoostedModel(Model):
    """A fitted booster. The first n trees are the booster of n rounds, so one fit serves every smaller number."""

    def __init__(self, assembler: VectorAssembler, booster: GBTClassificationModel):
        super().__init__()
        self.assembler, self.booster = assembler, booster

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return Predictions().transform(self.booster.transform(self.assembler.transform(dataset)))

    def leaf_values(self) -> np.ndarray:
        """weight * prediction of every leaf, by tree and leaf number (the order in which a tree prints its leaves)."""
        found = [[float(x) for x in re.findall(r"Predict: (\S+)", t.toDebugString)] for t in self.booster.trees]
        out = np.zeros((len(found), max(map(len, found))))
        for row, leaves, w in zip(out, found, self.booster.treeWeights, strict=True):
            row[:len(leaves)] = np.array(leaves) * w
        return out

    def at(self, dataset: DataFrame, rounds: Sequence[int]) -> DataFrame:
        """One row per input row and number of rounds: `rounds`, `score` and `pred`, scored in one pass."""
        values, counts = self.leaf_values(), np.array(sorted(rounds))

        @F.pandas_udf("array<double>")
        def margins(leaves: pd.Series) -> pd.Series:
            at = np.stack(leaves.to_numpy()).astype(np.int64)
            sums = np.cumsum(values[np.arange(len(values)), at], axis=1)
            return pd.Series(list(sums[:, np.minimum(counts, len(values)) - 1]))

        booster = self.booster.copy().setLeafCol("_leaf")
        placed = booster.transform(self.assembler.transform(dataset)).drop("rawPrediction", "probability", "prediction", "features")
        pairs = F.arrays_zip(F.array(*[F.lit(int(c)) for c in counts]).alias("rounds"), margins(vector_to_array("_leaf")).alias("margin"))
        each = placed.withColumn("_at", F.explode(pairs)).drop("_leaf")
        margin = F.col("_at.margin")
        return each.withColumns({"rounds": F.col("_at.rounds"), "score": 1.0 / (1.0 + F.exp(-2.0 * margin)),
                                 "pred": (margin > 0).cast("int")}).drop("_at")


class Boosted(Estimator):
    def __init__(self, booster: GBTClassifier, inputs: Sequence[str]):
        super().__init__()
        self.booster, self.inputs = booster, list(inputs)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        assembler = VectorAssembler(inputCols=self.inputs, outputCol="features")
        return BoostedModel(assembler, self.booster.fit(assembler.transform(dataset)))


def boosted(features, weighted=False, iterations=300, depth=5, step=0.1, subsample=1.0, min_rows=1, leaves=None, seed=42) -> Estimator:
    """`leaves` bounds the depth: the trees grow level by level, so about `leaves` leaves are ceil(log2 leaves) levels."""
    gbt = GBTClassifier(maxIter=iterations, maxDepth=booster_depth(depth, leaves), stepSize=step, subsamplingRate=subsample,
                        minInstancesPerNode=min_rows, seed=seed)
    return Boosted(_weighted(gbt, weighted), features)


def booster_depth(depth: int, leaves: int | None) -> int:
    return min(depth, math.ceil(math.log2(leaves))) if leaves else depth


def nearest(features, weighted=False, k=5, key="row_id") -> Estimator:
    from tabsieve.operators.knn import NearestNeighbours

    return NearestNeighbours(features, k, key)


# The nineteen entries of the leaderboard: (family, factory, defaults, needs scaled data).
REGISTRY: dict[str, tuple[str, Factory, dict, bool]] = {
    "dummy_majority": ("baseline", lambda features, weighted=False: Dummy(False), {}, False),
    "dummy_stratified": ("baseline", lambda features, weighted=False: Dummy(True), {}, False),
    "logistic": ("linear", logistic, {}, True),
    "sgd_log": ("linear", sgd_logistic, {}, True),
    "lda": ("linear", discriminant, {}, True),
    "linear_svm": ("linear", linear_svm, {}, True),
    "nystroem_svm": ("kernel", nystroem_svm, {}, True),
    "knn_5": ("neighbours", nearest, {"k": 5}, True),
    "knn_15": ("neighbours", nearest, {"k": 15}, True),
    "gaussian_nb": ("bayes", gaussian_nb, {}, True),
    "mlp_100": ("neural", perceptron, {"hidden": (100,)}, True),
    "mlp_64_32": ("neural", perceptron, {"hidden": (64, 32)}, True),
    "tree": ("trees", tree, {}, False),
    "forest": ("trees", forest, {}, False),
    "extra_trees": ("trees", random_trees, {}, False),
    "hist_gb": ("boosting", boosted, {"iterations": 100, "depth": 5}, False),
    "xgb": ("boosting", boosted, {"iterations": 300, "depth": 6}, False),
    "lgbm": ("boosting", boosted, {"iterations": 300, "depth": 5, "min_rows": 20}, False),
    "catboost": ("boosting", boosted, {"iterations": 500, "depth": 6, "step": 0.05}, False),
}


def build(name: str, features: Sequence[str], weighted: bool = False, **overrides) -> Estimator:
    """Estimator by name; register new ones by adding to REGISTRY."""
    _, factory, defaults, _ = REGISTRY[name]
    return factory(features, weighted, **{**defaults, **overrides})


# ---- search spaces ---------------------------------------------------------------------------

# Ranges of the searched hyper-parameters, reduced to what the booster and forest take.
# (kind, low, high); kind is int, uniform or log.
SPACES: dict[str, dict[str, tuple[str, float, float]]] = {
    "xgb": {"iterations": ("int", 100, 600), "depth": ("int", 3, 10), "step": ("log", 0.01, 0.3),
            "subsample": ("uniform", 0.6, 1.0), "min_rows": ("int", 1, 10)},
    "lgbm": {"iterations": ("int", 100, 600), "depth": ("int", 3, 12), "step": ("log", 0.01, 0.3),
             "subsample": ("uniform", 0.6, 1.0), "min_rows": ("int", 5, 100)},
    "tree": {"depth": ("int", 2, 12), "minInstancesPerNode": ("int", 1, 100)},
    "forest": {"trees": ("int", 100, 400), "depth": ("int", 5, 30), "minInstancesPerNode": ("int", 1, 10)},
}


def sample_space(space: dict[str, tuple[str, float, float]], n: int, seed: int = 42) -> list[dict]:
    """n parameter draws; the same seed gives the same list everywhere."""
    import math
    import random

    rng = random.Random(seed)
    draws = []
    for _ in range(n):
        point = {}
        for name, (kind, low, high) in space.items():
            if kind == "int":
                point[name] = rng.randint(int(low), int(high))
            elif kind == "log":
                point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                point[name] = rng.uniform(low, high)
        draws.append(point)
    return draws


def canonical(name: str, point: dict) -> dict:
    """The point as the estimator sees it: points that differ only in what it ignores are one fit."""
    if REGISTRY[name][1] is not boosted or point.get("leaves") is None:
        return dict(point)
    rest = {k: v for k, v in point.items() if k != "leaves"}
    return rest | {"depth": booster_depth(int(point.get("depth", 5)), int(point["leaves"]))}


def grows_by(name: str) -> str | None:
    """The parameter whose smaller values are contained in a fit with a larger one."""
    return "iterations" if REGISTRY[name][1] is boosted else None


def grid(**values: Sequence) -> list[dict]:
    from itertools import product

    return [dict(zip(values, combo, strict=True)) for combo in product(*values.values())]
