"""Evaluation protocol: cross-validation, search, nested validation, ensembles, transfer.

A frame is tagged with folds once and cached while it is read; every (model, fold) fit runs as its own Spark jobs,
several at a time from a small thread pool; the validation predictions of all models and folds
are unioned lazily and scored by one aggregation grouped by (model, fold).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tabsieve.operators.metrics import binary_metrics
from tabsieve.operators.models import Linear
from tabsieve.operators.split import learning_sizes, stratified_kfold
from tabsieve.session import ensure_checkpoint_dir
from tabsieve.sources.files import union_all
from tabsieve.sources.sinks import written

#: Fits side by side, at least; as many more as cores are free beside a table of few partitions.
PARALLEL = 4
#: Rows of fits side by side: every fit keeps its rows, and one fit of a large table uses all cores by itself.
ROWS_SIDE_BY_SIDE = 20_000_000
#: Rows of a partition of a table that is fitted many times: every job of a fit pays for each of its tasks.
ROWS_A_TASK = 50_000
#: The most rows of such a partition when other fits keep the cores busy.
ROWS_A_FIT = 500_000
KEEP = ("row_id", "label", "pred", "score")
Resampler = Callable[[DataFrame], DataFrame]


def parallel(tasks: Sequence[Callable[[], object]], threads: int = PARALLEL) -> list:
    """Run independent job sequences side by side, results in order."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPool(min(threads, len(tasks))) as pool:
        spark = SparkSession.getActiveSession()
        run = inheritable_thread_target(spark)(lambda t: t()) if spark else (lambda t: t())
        return pool.map(run, list(tasks))


def side_by_side(rows: int, threads: int = PARALLEL) -> int:
    return max(1, min(threads, ROWS_SIDE_BY_SIDE // max(1, rows)))


def compact(df: DataFrame, rows: int | None = None, fits: int = 1) -> DataFrame:
    """The table in partitions of about ROWS_A_TASK rows, never in more than it has. Where several fits share the cores, in
    no more than give each fit its share of them, but none of more than ROWS_A_FIT rows."""
    rows = df.count() if rows is None else rows
    parts = max(1, -(-rows // ROWS_A_TASK))
    if fits > 1:
        share = -(-df.sparkSession.sparkContext.defaultParallelism // fits)
        parts = max(-(-rows // ROWS_A_FIT), min(parts, share), 1)
    return df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df


def _tagged(df: DataFrame, label: str, k: int, seed: int, key: str) -> DataFrame:
    return df if {"fold", "folds"} & set(df.columns) else stratified_kfold(df, label, k, seed, key)


def out_of_fold(
    df: DataFrame, estimators: Mapping[str, Estimator], k: int = 5, seed: int = 42, label: str = "label",
    key: str = "row_id", resample: Resampler | Mapping[str, Resampler] | None = None, threads: int | None = None, extra: Sequence[str] = (),
    rounds: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """(model, fold, row_id, label, pred, score, fit_time_s): one prediction per row and model.

    `df` may already carry a `fold` column, or an array `folds` with a fold for every repeat: then `fold` numbers the
    blocks repeat * k + fold, and each model predicts every row once a repeat. Resampling, one for all or one for each model
    it names, only ever touches the training side. Every fit reads
    the table again, so callers cache it (`cross_validate` does). A model named in `rounds` is scored at each of
    these numbers of rounds from its one fit; its rows are named model@rounds.
    """
    threads, rounds = threads or PARALLEL, rounds or {}
    spread = _tagged(df, label, k, seed, key)
    if "folds" in spread.columns:
        found = sorted({(i, f) for r in spread.select("folds").distinct().collect() for i, f in enumerate(r["folds"])})
        held = {n: F.col("folds")[i] == f for n, (i, f) in enumerate(found)}
    else:
        held = {r["fold"]: F.col("fold") == r["fold"] for r in spread.select("fold").distinct().collect()}

    def task(name: str, est: Estimator, fold: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            train = spread.filter(~held[fold]).drop("fold", "folds")
            start = time.perf_counter()
            scheme = resample.get(name) if isinstance(resample, Mapping) else resample
            model = est.fit(scheme(train) if scheme else train)
            spent = time.perf_counter() - start
            valid, named = spread.filter(held[fold]).drop("folds").withColumn("fold", F.lit(fold)), F.lit(name)
            if name in rounds:
                scored, named = model.at(valid, rounds[name]), F.concat(named, F.lit("@"), F.col("rounds").cast("string"))
            else:
                scored = model.transform(valid)
            return scored.select(named.alias("model"), "fold", *KEEP, *extra, F.lit(spent).alias("fit_time_s"))
        return run

    tasks = [task(n, e, f) for n, e in estimators.items() for f in sorted(held)]
    return union_all(parallel(tasks, threads))


def cross_validate(df: DataFrame, estimators: Mapping[str, Estimator], k: int = 5, seed: int = 42,
                   label: str = "label", key: str = "row_id", resample: Resampler | Mapping[str, Resampler] | None = None,
                   areas: bool = True, rounds: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """(model, fold, metric..., fit_time_s): the fold scores, kept for paired tests."""
    # Written once: the metrics below read it several times, and its plan holds every fitted model.
    ensure_checkpoint_dir(df.sparkSession)
    size = df.count()
    tagged = _tagged(df, label, k, seed, key)
    blocks = len(estimators) * (k if "folds" not in tagged.columns else k * tagged.select(F.size("folds")).first()[0])
    tagged = compact(tagged, size, blocks).persist()
    try:
        threads = max(PARALLEL, df.sparkSession.sparkContext.defaultParallelism // max(1, tagged.rdd.getNumPartitions()))
        oof = written(out_of_fold(tagged, estimators, k, seed, label, key, resample, side_by_side(size, threads),
                                  rounds=rounds).drop("row_id"), "out-of-fold")
    finally:
        tagged.unpersist()
    m = binary_metrics(oof, score="score" if areas else None, by=["model", "fold"])
    spent = oof.groupBy("model", "fold").agg(F.max("fit_time_s").alias("fit_time_s"))
    return m.join(spent, ["model", "fold"])


def summarise(folds: DataFrame) -> DataFrame:
    """(model, <metric>_mean, <metric>_std...): population deviation over folds."""
    skip = {"model", "fold", "tn", "fp", "fn", "tp"}
    names = [c for c in folds.columns if c not in skip]
    return folds.groupBy("model").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in names], *[F.stddev_pop(c).alias(f"{c}_std") for c in names if c != "fit_time_s"])


def leaderboard(df: DataFrame, estimators: Mapping[str, Estimator], families: Mapping[str, str] | None = None,
                k: int = 5, seed: int = 42, metric: str = "f1_mean", areas: bool = True) -> DataFrame:
    table = summarise(cross_validate(df, estimators, k, seed, areas=areas))
    if families:
        fam = df.sparkSession.createDataFrame(list(families.items()), "model string, family string")
        table = table.join(F.broadcast(fam), "model", "left")
    return table.orderBy(F.desc(metric), "model")


def best_non_dummy(table: DataFrame, n: int = 3, metric: str = "f1_mean") -> DataFrame:
    return table.filter(~F.col("model").startswith("dummy")).orderBy(F.desc(metric), "model").limit(n)


def holdout(train: DataFrame, test: DataFrame, estimator: Estimator) -> DataFrame:
    """Fit on all of train, score the reserved test once: the predictions table, written once."""
    ensure_checkpoint_dir(test.sparkSession)
    return written(estimator.fit(train).transform(test).select(*KEEP), "holdout")


# ---- search ----------------------------------------------------------------------------------

def search(df: DataFrame, factory: Callable[..., Estimator], points: Sequence[Mapping], k: int = 3, seed: int = 42,
           metric: str = "f1", canonical: Callable[[Mapping], Mapping] = dict, grows_by: str | None = None) -> DataFrame:
    """(trial, <params>, value): the trial table of a grid or random search on shared folds.

    Points that `canonical` maps to the same parameters are one fit. With `grows_by`, points that differ only in that
    parameter share the fit with its largest value, whose model scores the smaller ones too (`Model.at`).
    """
    fits: dict[tuple, dict[int, list[int]]] = {}
    for i, p in enumerate(points):
        own = dict(canonical(p))
        size = int(own.pop(grows_by)) if grows_by else 0
        fits.setdefault(tuple(sorted(own.items())), {}).setdefault(size, []).append(i)
    estimators, rounds, trials = {}, {}, []
    for n, (own, sizes) in enumerate(fits.items()):
        estimators[str(n)] = factory(**dict(own), **({grows_by: max(sizes)} if grows_by else {}))
        if len(sizes) > 1:
            rounds[str(n)] = sorted(sizes)
        trials += [(i, f"{n}@{size}" if len(sizes) > 1 else str(n)) for size, members in sizes.items() for i in members]
    folds = cross_validate(df, estimators, k, seed, areas=metric in ("roc_auc", "average_precision"), rounds=rounds)
    scores = folds.groupBy("model").agg(F.avg(metric).alias("value"))
    names = sorted({n for p in points for n in p})
    model = dict(trials)
    rows = [(i, model[i], *[float(p[n]) if p.get(n) is not None else None for n in names]) for i, p in enumerate(points)]
    table = df.sparkSession.createDataFrame(rows, "trial int, model string, " + ", ".join(f"{n} double" for n in names))
    return table.join(scores, "model").drop("model")


def best_point(trials: DataFrame, points: Sequence[Mapping]) -> tuple[dict, float]:
    row = trials.orderBy(F.desc("value"), "trial").first()
    return dict(points[row["trial"]]), float(row["value"])


def nested_cv(df: DataFrame, factory: Callable[..., Estimator], sampler: Callable[[int], Sequence[Mapping]],
              outer: int = 5, inner: int = 3, seed: int = 42, metric: str = "f1", label: str = "label", **options) -> DataFrame:
    """(fold, inner_score, outer_score, bias): optimism of the inner search per outer fold. `options` go to `search`."""
    tagged = compact(stratified_kfold(df, label, outer, seed)).persist()
    rows = []
    try:
        for fold in range(outer):
            train, valid = (tagged.filter(c).drop("fold") for c in (F.col("fold") != fold, F.col("fold") == fold))
            points = list(sampler(seed + fold))
            point, inner_score = best_point(search(train, factory, points, inner, seed, metric, **options), points)
            got = binary_metrics(holdout(train, valid, factory(**point)), score=None).first()[metric]
            rows.append((fold, inner_score, float(got), inner_score - float(got)))
    finally:
        tagged.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, inner_score double, outer_score double, bias double")


def learning_curve(df: DataFrame, estimator: Estimator, steps: int = 6, k: int = 3, seed: int = 42,
                   label: str = "label", metric: str = "f1") -> DataFrame:
    """(step, fold, rows, train, validation, gap): nested training sizes, fixed validation folds."""
    ensure_checkpoint_dir(df.sparkSession)
    size = df.count()
    tagged = written(stratified_kfold(df, label, k, seed), "folds", size)
    sized = compact(union_all([
        learning_sizes(tagged.filter(F.col("fold") != f), label, steps, seed=seed + 1).withColumn("hold", F.lit(f))
        for f in range(k)])).persist()
    valid = compact(tagged, size).persist()

    def task(step: int, fold: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            train = sized.filter((F.col("hold") == fold) & (F.col("step") <= step)).drop("hold", "step", "fold")
            model = estimator.fit(train)
            tag = [F.lit(step).alias("step"), F.lit(fold).alias("fold")]
            return model.transform(train).select(*tag, F.lit("train").alias("side"), *KEEP).unionByName(
                model.transform(valid.filter(F.col("fold") == fold).drop("fold")).select(
                    *tag, F.lit("validation").alias("side"), *KEEP))
        return run

    try:
        tasks = [task(s, f) for s in range(1, steps + 1) for f in range(k)]
        preds = union_all(parallel(tasks, side_by_side(size)))
        m = written(binary_metrics(preds, score=None, by=["step", "fold", "side"]), "learning-curve")  # one row a side
    finally:
        sized.unpersist()
        valid.unpersist()
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    side = lambda s, c: F.max(F.when(F.col("side") == s, c))
    return m.groupBy("step", "fold").agg(
        side("train", n).alias("rows"), side("train", F.col(metric)).alias("train"),
        side("validation", F.col(metric)).alias("validation"),
    ).withColumn("gap", F.col("train") - F.col("validation"))


def transfer_matrix(sets: Mapping[str, DataFrame], estimator: Estimator) -> DataFrame:
    """(origin, target, metrics...): one fit per origin, scored on every set."""
    ensure_checkpoint_dir(next(iter(sets.values())).sparkSession)

    def task(origin: str) -> Callable[[], list[DataFrame]]:
        def run() -> list[DataFrame]:
            model = estimator.fit(sets[origin])
            return [model.transform(d).select(F.lit(origin).alias("origin"), F.lit(t).alias("target"), *KEEP)
                    for t, d in sets.items()]
        return run

    preds = union_all([p for chunk in parallel([task(o) for o in sets]) for p in chunk]).checkpoint()
    return binary_metrics(preds, by=["origin", "target"])


# ---- ensembles -------------------------------------------------------------------------------

class SoftVoteModel(Model):
    def __init__(self, members: Sequence[Model]):
        super().__init__()
        self.members = list(members)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, m in enumerate(self.members):  # members are chained on the same row: no join
            out = m.transform(out).withColumnRenamed("score", f"_s{i}").drop("pred")
        mean = sum((F.col(f"_s{i}") for i in range(1, len(self.members))), F.col("_s0")) / len(self.members)
        return out.withColumn("score", mean).withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop(
            *[f"_s{i}" for i in range(len(self.members))])


class SoftVote(Estimator):
    """Average of the members' probabilities."""

    def __init__(self, members: Sequence[Estimator]):
        super().__init__()
        self.members = list(members)

    def _fit(self, dataset: DataFrame) -> SoftVoteModel:
        return SoftVoteModel(parallel([lambda e=e: e.fit(dataset) for e in self.members]))


class StackModel(Model):
    def __init__(self, members: Sequence[Model], final: Model):
        super().__init__()
        self.members, self.final = list(members), final

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        names = []
        for i, m in enumerate(self.members):
            names.append(f"_s{i}")
            out = m.transform(out).withColumnRenamed("score", f"_s{i}").drop("pred")
        return self.final.transform(out).drop(*names)


class Stack(Estimator):
    """Out-of-fold member scores feed a logistic regression; members are refitted on all rows."""

    def __init__(self, members: Mapping[str, Estimator], k: int = 3, seed: int = 42):
        super().__init__()
        self.members, self.k, self.seed = dict(members), k, seed

    def _fit(self, dataset: DataFrame) -> StackModel:
        names = [f"_s{i}" for i in range(len(self.members))]
        ensure_checkpoint_dir(dataset.sparkSession)
        tagged = written(_tagged(dataset, "label", self.k, self.seed, "row_id"), "stack-folds")
        sizes = {r["fold"]: r["count"] for r in tagged.groupBy("fold").count().collect()}
        threads = side_by_side(sum(sizes.values()))
        fits = parallel([lambda e=e, f=f: e.fit(tagged.filter(F.col("fold") != f).drop("fold"))
                         for f in sorted(sizes) for e in self.members.values()], threads)
        held = []
        for n, f in enumerate(sorted(sizes)):  # the members are chained on the same row: no join
            out = tagged.filter(F.col("fold") == f).drop("fold")
            for name, m in zip(names, fits[n * len(names):], strict=False):
                out = m.transform(out).withColumnRenamed("score", name).drop("pred")
            held.append(out.select(F.col("label").cast("double").alias("label"), *names))
        final = Linear(LogisticRegression(labelCol="label"), names).fit(written(union_all(held), "stack-scores"))
        return StackModel(parallel([lambda e=e: e.fit(dataset) for e in self.members.values()], threads), final)


class CalibratedModel(Model):
    def __init__(self, pairs: Sequence[tuple[Model, Model]], method: str):
        super().__init__()
        self.pairs, self.method = list(pairs), method

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, (model, cal) in enumerate(self.pairs):
            scored = model.transform(out).withColumnRenamed("score", "_raw").drop("pred")
            if self.method == "sigmoid":
                out = cal.transform(scored).withColumnRenamed("score", f"_c{i}").drop("pred", "_raw")
            else:
                vec = VectorAssembler(inputCols=["_raw"], outputCol="_rv").transform(scored)
                out = cal.transform(vec).withColumnRenamed("prediction", f"_c{i}").drop("_raw", "_rv")
        n = len(self.pairs)
        mean = sum((F.col(f"_c{i}") for i in range(1, n)), F.col("_c0")) / n
        return out.withColumn("score", mean).withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop(
            *[f"_c{i}" for i in range(n)])


class Calibrated(Estimator):
    """Per fold: a model on the other parts and a sigmoid or isotonic calibrator on the held one."""

    def __init__(self, base: Estimator, method: str = "sigmoid", k: int = 5, seed: int = 42):
        super().__init__()
        self.base, self.method, self.k, self.seed = base, method, k, seed

    def _fit(self, dataset: DataFrame) -> CalibratedModel:
        tagged = stratified_kfold(dataset, "label", self.k, self.seed).persist()

        def pair(fold: int) -> tuple[Model, Model]:
            model = self.base.fit(tagged.filter(F.col("fold") != fold).drop("fold"))
            held = model.transform(tagged.filter(F.col("fold") == fold)).select(
                F.col("label").cast("double").alias("label"), F.col("score").alias("_raw"))
            if self.method == "sigmoid":
                return model, Linear(LogisticRegression(labelCol="label"), ["_raw"]).fit(held)
            vec = VectorAssembler(inputCols=["_raw"], outputCol="_rv").transform(held)
            return model, IsotonicRegression(featuresCol="_rv", labelCol="label").fit(vec)

        try:
            pairs = parallel([lambda f=f: pair(f) for f in range(self.k)], side_by_side(tagged.count()))
        finally:
            tagged.unpersist()
        return CalibratedModel(pairs, self.method)


def long_scores(folds: DataFrame, comparison: str, metric: str = "f1", block: str = "fold") -> DataFrame:
    """Fold scores in the shape the paired tests take."""
    return folds.select(F.lit(comparison).alias("comparison"), "model", F.col(block).alias("block"),
                        F.col(metric).alias("score"))


