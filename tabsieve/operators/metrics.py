"""Binary classification metrics on a predictions table (row_id, label, pred, score).

Counts are one conditional aggregate; everything that depends on the order of scores works on
the score histogram (score, positives, negatives), whose size is the number of distinct scores,
and accumulates it with two-level running totals. `by` evaluates folds, replicates or scenarios
in the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.scalar import hash_uniform, safe_ratio
from tabsieve.operators.distribution import bucket_by_sketch, exact_quantiles, locate, running_totals
from tabsieve.operators.split import poisson_draws
from tabsieve.session import ensure_checkpoint_dir

EPS = 1e-15  # score clipping of the log loss


def _is(c: str | Column, v: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c) == v


def confusion(preds: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = (),
              weight: Column | None = None) -> DataFrame:
    def cell(y: int, p: int) -> Column:
        cond = _is(label, y) & _is(pred, p)
        if weight is None:
            return F.count_if(cond)
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0))

    return preds.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def confusion_rates(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, n, row_share)."""
    n = preds.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def rate_columns() -> dict[str, Column]:
    """The named metric set over confusion counts (zero denominators give 0). Extend by adding entries."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall, spec, prec = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp), safe_ratio(tp, tp + fp)
    return {
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (recall + spec) / 2,
        "precision": prec,
        "recall": recall,
        "specificity": spec,
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": safe_ratio(tp * tn - fp * fn,
                          F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
    }


def rates_from_counts(counts: DataFrame, metrics: dict[str, Column] | None = None) -> DataFrame:
    return counts.withColumns(metrics or rate_columns())


def probability_losses(preds: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    y, s = F.col(label).cast("double"), F.col(score)
    p = F.least(F.greatest(s, F.lit(EPS)), F.lit(1 - EPS))
    return preds.groupBy(*by).agg(
        F.avg((s - y) * (s - y)).alias("brier"),
        (-F.avg(F.when(_is(label, 1), F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def score_histogram(preds: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
                    weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return preds.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(_is(label, 1), w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(_is(label, 1), 0).otherwise(w)).cast("bigint").alias("neg"))


def score_curve(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histogram + tp, fp at each threshold (score >= threshold) and the class totals p, q."""
    groups = list(by) or ["_all"]
    h = hist if by else hist.withColumn("_all", F.lit(0))
    cum = running_totals(bucket_by_sketch(h, groups, "score"), groups, "bucket", "score",
                         ["pos", "neg"], descending=True)
    totals = h.groupBy(*groups).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    out = cum.join(F.broadcast(totals), groups).select(  # one row per group of `by`, which is low-cardinality
        *groups, "score", "pos", "neg", F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"), "p", "q")
    return out if by else out.drop("_all")


def area_metrics(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision (step sum)."""
    c = score_curve(hist, by)
    d = lambda n: F.col(n).cast("double")
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(d("neg") * (d("tp") - d("pos") + d("pos") / 2)), F.max(d("p")) * F.max(d("q"))).alias("roc_auc"),
        F.sum(F.try_divide(d("pos"), d("p")) * F.try_divide(d("tp"), d("tp") + d("fp"))).alias("average_precision"))


def roc_auc(preds: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return area_metrics(score_histogram(preds, label, score, by), by).select(*by, "roc_auc")


def average_precision(preds: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return area_metrics(score_histogram(preds, label, score, by), by).select(*by, "average_precision")


def binary_metrics(preds: DataFrame, label: str = "label", pred: str = "pred", score: str | None = "score",
                   by: Sequence[str] = ()) -> DataFrame:
    """One row per group with counts, rates, areas and losses."""
    by = list(by)
    groups = by or ["_all"]
    p = preds if by else preds.withColumn("_all", F.lit(0))
    out = rates_from_counts(confusion(p, label, pred, groups))
    if score:
        out = out.join(area_metrics(score_histogram(p, label, score, groups), groups), groups).join(
            probability_losses(p, label, score, groups), groups)
    return out if by else out.drop("_all")


def metrics_long(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in by and c not in ("tn", "fp", "fn", "tp")]
    return wide.unpivot(list(by), names, "metric", "value")


# ---- curves and thresholds -------------------------------------------------------------------

def pr_curve(preds: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall, f1) at every distinct score."""
    c = score_curve(score_histogram(preds, label, score, by), by)
    prec = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_ratio(F.col("tp"), F.col("p"))
    return c.select(*by, F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"),
                    safe_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("f1"))


def roc_curve(preds: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    c = score_curve(score_histogram(preds, label, score, by), by)
    return c.select(*by, F.col("score").alias("threshold"), safe_ratio(F.col("fp"), F.col("q")).alias("fpr"),
                    safe_ratio(F.col("tp"), F.col("p")).alias("tpr"))


def best_f1_threshold(preds: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Lowest threshold among those of maximal F1."""
    return pr_curve(preds, label, score, by).groupBy(*by).agg(
        F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")
    ).select(*by, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def threshold_for_recall(preds: DataFrame, target: float = 0.97, label: str = "label", score: str = "score",
                         by: Sequence[str] = ()) -> DataFrame:
    """Highest threshold whose recall still reaches the target."""
    c = pr_curve(preds, label, score, by)
    return c.filter(F.col("recall") >= target).groupBy(*by).agg(F.max("threshold").alias("threshold"))


def _unit_rows(preds: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Each row as a histogram of itself: bins are found on the scanned rows, so only bins are shuffled."""
    hit = F.when(_is(label, 1), 1).otherwise(0).cast("bigint")
    return preds.select(*by, F.col(score).alias("score"), hit.alias("pos"), (1 - hit).alias("neg"))


def _counts_on_grid(hist: DataFrame, by: Sequence[str], grid: tuple[float, float, int] | Sequence[float]) -> DataFrame:
    """Confusion counts at each threshold; the rows are first collapsed to the grid's intervals."""
    if isinstance(grid, tuple):
        start, stop, num = grid
        points = [round(start + (stop - start) * i / (num - 1), 12) for i in range(num)]
    else:
        points = sorted(float(t) for t in grid)
    edges = F.array(*[F.lit(t) for t in points])
    placed = locate(hist.withColumn("_grid", edges), "_grid", F.col("score"), len(points), "slot", inclusive=True)
    per = placed.groupBy(*by, "slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    expanded = per.select(*by, "slot", "pos", "neg", F.posexplode(edges).alias("i", "threshold"))
    above = F.col("slot") > F.col("i")
    pick = lambda c, m: F.sum(F.when(m, F.col(c)).otherwise(0))
    return expanded.groupBy(*by, "threshold").agg(
        pick("neg", ~above).alias("tn"), pick("neg", above).alias("fp"),
        pick("pos", ~above).alias("fn"), pick("pos", above).alias("tp"))


def metrics_at(preds: DataFrame, thresholds: Sequence[float], label: str = "label", score: str = "score",
               by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates at given operating points."""
    return rates_from_counts(_counts_on_grid(_unit_rows(preds, label, score, by), by, list(thresholds)))


# The protocol's threshold grids and cost ratios.
F1_GRID = (0.01, 0.99, 197)
COST_GRID = (0.05, 0.95, 91)
COST_RATIOS = (1, 3, 5, 10)


def best_threshold(preds: DataFrame, grid: tuple[float, float, int] = F1_GRID, label: str = "label",
                   score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """First grid point of maximal F1."""
    c = rates_from_counts(_counts_on_grid(_unit_rows(preds, label, score, by), by, grid))
    return c.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")).select(
        *by, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def expected_cost(preds: DataFrame, grid: tuple[float, float, int] = COST_GRID, ratios: Sequence[int] = COST_RATIOS,
                  label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(threshold, ratio, cost): mean cost per row when a miss costs `ratio` false alarms."""
    c = _counts_on_grid(_unit_rows(preds, label, score, by), by, grid)
    c = c.withColumn("ratio", F.explode(F.array(*[F.lit(int(r)) for r in ratios])))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return c.select(*by, "threshold", "ratio", ((F.col("fn") * F.col("ratio") + F.col("fp")) / n).alias("cost"))


def cheapest_threshold(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return costs.groupBy(*by, "ratio").agg(F.min(F.struct("cost", "threshold")).alias("b")).select(
        *by, "ratio", F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost"))


def reliability(preds: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """(bin, n, mean_score, observed): equal-frequency bins, empty ones left out."""
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(preds, [score], probs).agg(F.array_sort(F.collect_list("q")).alias("edges"))
    hist = _unit_rows(preds, label, score).join(F.broadcast(edges))
    n = F.col("pos") + F.col("neg")
    return locate(hist, "edges", F.col("score"), bins, "bin").groupBy("bin").agg(
        F.sum(n).alias("n"), (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_score"),
        (F.sum("pos") / F.sum(n)).alias("observed"))


def base_rate_projection(preds: DataFrame, prevalences: Sequence[float] = (0.3497, 0.1, 0.01, 0.001),
                         rows: int = 1_000_000, label: str = "label", pred: str = "pred",
                         by: Sequence[str] = ()) -> DataFrame:
    """Outcomes per `rows` cases if the positive share were each of the prevalences."""
    r = rates_from_counts(confusion(preds, label, pred, by))
    r = r.withColumn("prevalence", F.explode(F.array(*[F.lit(float(x)) for x in prevalences])))
    return project_base_rate(r, rows, by)


def project_base_rate(rates: DataFrame, rows: int = 1_000_000, by: Sequence[str] = ()) -> DataFrame:
    """From (recall, specificity, prevalence) to TP, FN, FP and precision per `rows` cases."""
    pos = F.col("prevalence") * rows
    neg = F.lit(float(rows)) - pos
    tp, fp = pos * F.col("recall"), neg * (1 - F.col("specificity"))
    return rates.select(*by, "prevalence", tp.alias("tp"), (pos - tp).alias("fn"), fp.alias("fp"),
                        safe_ratio(tp, tp + fp).alias("precision"))


def confusion_cell(label: str = "label", pred: str = "pred") -> Column:
    y, p = _is(label, 1), _is(pred, 1)
    return F.when(y & p, "TP").when(y & ~p, "FN").when(~y & p, "FP").otherwise("TN")


# ---- bootstrap -------------------------------------------------------------------------------

#: Rows whose weights in all replicates a task lays out at a time.
_DRAWN_ROWS = 512
_CELLS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """label, pred, score of some rows and their weights, (row, replicate)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _DRAWN_ROWS):
            part = batch.slice(lo, _DRAWN_ROWS)
            label, pred, score, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "pred", "score", "n"))
            u = part.column("u").flatten().to_numpy().reshape(part.num_rows, -1)
            w = poisson_draws(np.repeat(n.astype("float64"), u.shape[1]), u.reshape(-1)).reshape(u.shape)
            yield label, pred, score, w


def _replicate_sums(replicates: int) -> Callable:
    """Per partition the sums of all replicates: the four cells, squared errors, positives and the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((7, replicates))
        for label, pred, score, w in _drawn(batches):
            for i, (y, p) in enumerate(_CELLS):
                sums[i] += w[(label == y) & (pred == p)].sum(0)
            sums[4] += ((score - label) ** 2) @ w
            sums[5] += w[label == 1].sum(0)
            sums[6] += w[label != 1].sum(0)
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([part, pa.array([sums.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["part", "sums"])
    return run


def _replicate_areas(before: dict[int, np.ndarray], total: np.ndarray) -> Callable:
    """Per partition of descending scores the parts of both areas. `before` holds the positives and the rest that
    lie in partitions of higher scores, `total` those of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tp, fp = before[TaskContext.get().partitionId()].copy()
        roc, precise = np.zeros_like(tp), np.zeros_like(tp)
        held: tuple | None = None  # the last score of the rows before, which may go on

        def add(pos: np.ndarray, neg: np.ndarray) -> None:
            nonlocal tp, fp, roc, precise
            above, reached = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
            roc = roc + (neg * (above - pos / 2)).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                precise = precise + np.where(above > 0, pos / total[0] * above / (above + reached), 0.0).sum(0)
            tp, fp = above[-1], reached[-1]

        for label, _, score, w in _drawn(batches):
            new = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
            pos, neg = (np.add.reduceat(np.where(c[:, None], w, 0.0), new, axis=0) for c in (label == 1, label != 1))
            if held is not None:
                if held[0] == score[0]:
                    pos[0] += held[1]
                    neg[0] += held[2]
                else:
                    add(held[1][None], held[2][None])
            held = score[-1], pos[-1], neg[-1]
            if len(pos) > 1:
                add(pos[:-1], neg[:-1])
        if held is not None:
            add(held[1][None], held[2][None])
        yield pa.RecordBatch.from_arrays([pa.array([[*roc, *precise]], pa.list_(pa.float64()))], names=["areas"])
    return run


def bootstrap_metrics(preds: DataFrame, replicates: int = 1000, label: str = "label", pred: str = "pred",
                      score: str = "score", areas: bool = True) -> DataFrame:
    """(replicate, metric, value).

    Equal rows are counted once and only these counts are shuffled, by ranges of the score. Tasks draw the weights of
    all replicates for a few rows at a time and keep sums per replicate: one scan for counts and losses, a second one,
    which knows the sums of the ranges above, for the areas. Each range sends 7 and 2 numbers a replicate. A row's
    weight depends on its values and the replicate alone, so reruns and other partitions give the same replicates.
    """
    spark = preds.sparkSession
    ensure_checkpoint_dir(spark)
    hist = preds.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred"), F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"))
    placed = hist.repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score"), "label", "pred").checkpoint()
    draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: hash_uniform(
        r, F.col("label"), F.col("pred"), F.col("score")))
    drawn = placed.select(
        F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"), "score", F.col("n").cast("double").alias("n"),
        draws.alias("u"))
    found = sorted(drawn.mapInArrow(_replicate_sums(replicates), "part int, sums array<double>").collect(), key=lambda r: r["part"])
    parts = np.array([r["sums"] for r in found]).reshape(len(found), 7, replicates)
    sums = parts.sum(0)
    rows = [(i, *(int(x) for x in sums[:4, i]), float(sums[4, i] / n) if n else None)
            for i, n in enumerate(sums[5] + sums[6])]
    out = rates_from_counts(spark.createDataFrame(rows, "replicate int, tn long, fp long, fn long, tp long, brier double"))
    if areas:
        above = np.cumsum(parts[:, 5:], axis=0) - parts[:, 5:]
        before = {r["part"]: above[i] for i, r in enumerate(found)}
        got = np.array([r["areas"] for r in drawn.mapInArrow(_replicate_areas(before, sums[5:]), "areas array<double>").collect()])
        roc, precise = got.reshape(len(got), 2, replicates).sum(0)
        both = sums[5] * sums[6]
        rows = [(i, float(roc[i] / both[i]) if both[i] else None, float(precise[i]) if sums[5, i] else None) for i in range(replicates)]
        out = out.join(spark.createDataFrame(rows, "replicate int, roc_auc double, average_precision double"), "replicate")
    return metrics_long(out, ["replicate"])


def bootstrap_intervals(boot: DataFrame, level: float = 0.95) -> DataFrame:
    """(metric, lo, hi): percentile interval over the replicates (a bounded number of values)."""
    a = (1 - level) / 2
    return boot.groupBy("metric").agg(
        F.percentile("value", F.lit(a)).alias("lo"), F.percentile("value", F.lit(1 - a)).alias("hi"))

