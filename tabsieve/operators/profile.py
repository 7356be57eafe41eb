"""Profiling and leakage audit of wide labelled tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.scalar import right_closed_bin
from tabsieve.operators.distribution import (
    HITTERS, average_ranks, column_aggregate, exact_medians, exact_quantiles, few_values, heavy_hitters, locate, long_form, value_histogram,
)


# ---- classes ---------------------------------------------------------------------------------

def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.select(
        *by, label, "n",
        (F.col("n") / F.sum("n").over(w)).alias("share"),
        (F.max("n").over(w) / F.min("n").over(w)).alias("imbalance_ratio"),
    )


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))


def balance_before_after(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    a = before.groupBy(label).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(label).agg(F.count(F.lit(1)).alias("n_after"))
    w = Window.partitionBy(F.lit(0))
    return a.join(b, label, "left").fillna({"n_after": 0}).select(
        label, "n_before", "n_after",
        (F.col("n_before") / F.sum("n_before").over(w)).alias("share_before"),
        F.try_divide("n_after", F.sum("n_after").over(w)).alias("share_after"),  # NULL when no row is left
    )


# ---- missing cells ---------------------------------------------------------------------------

def sentinel_profile(df: DataFrame, features: Sequence[str], sentinel: float = -1.0) -> DataFrame:
    stats = column_aggregate(df, features, {
        "n": lambda c: F.count_if(c == F.lit(sentinel)),
        "total": lambda c: F.count(F.lit(1)),
    })
    return stats.filter(F.col("n") > 0).select(
        "variable", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def null_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    stats = column_aggregate(df, features, {
        "n": lambda c: F.count_if(c.isNull()), "total": lambda c: F.count(F.lit(1)),
    })
    return stats.filter(F.col("n") > 0).select(
        "variable", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def missingness_levels(nulls: DataFrame, decimals: int = 3) -> DataFrame:
    """Columns grouped by an identical missing share: size and alphabetically first member."""
    return nulls.groupBy(F.round("pct", decimals).alias("pct")).agg(
        F.count(F.lit(1)).alias("n_columns"), F.min("variable").alias("example"))


def null_cooccurrence(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, r): correlation of the null indicators of every pair, NULL where one is constant."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in features])
    return pearson_pairs(flags, features)


# ---- values ----------------------------------------------------------------------------------

def distinct_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return value_histogram(df, features).groupBy("variable").agg(F.count("value").alias("n_distinct"))


def approx_distinct_counts(df: DataFrame, features: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """Sketch version for exploration of very wide continuous columns."""
    return column_aggregate(
        df, features, {"n_distinct": lambda c: F.approx_count_distinct(c, rsd)}, buffers_each=60)


def dominance(df: DataFrame, features: Sequence[str], k: int = HITTERS) -> DataFrame:
    """Share of the most frequent value, NULL counted as a value. Columns without rows give none.

    Exact from two scans for every column whose top value holds more than about 1 / k of the rows (`heavy_hitters`). Only
    the columns without such a value, whose top count can be that of any value, have their values shuffled.
    """
    found = {name: (top, total, sure) for name, top, total, sure in heavy_hitters(df, features, k)}
    rows = [(name, top / total) for name, (top, total, sure) in found.items() if sure]
    out = df.sparkSession.createDataFrame(rows, "variable string, dominance double")
    light = [name for name, (_, _, sure) in found.items() if not sure]
    if not light:
        return out
    return out.unionByName(value_histogram(df, light).groupBy("variable").agg((F.max("n") / F.sum("n")).alias("dominance")))


def constancy(df: DataFrame, features: Sequence[str], quasi: float = 0.99, k: int = HITTERS) -> DataFrame:
    """(variable, dominance, kind): constant, quasi_constant (dominance >= quasi) or varied. dominance is NULL where no
    value holds about 1 / k of the rows; `quasi` must be above that."""
    if quasi <= 2 / k:
        raise ValueError(f"quasi must be above {2 / k}")
    rows = []
    for name, top, total, sure in heavy_hitters(df, features, k):
        kind = "constant" if top == total else "quasi_constant" if sure and top / total >= quasi else "varied"
        rows.append((name, top / total if sure else None, kind))
    return df.sparkSession.createDataFrame(rows, "variable string, dominance double, kind string")


def variable_types(df: DataFrame, features: Sequence[str], discrete_max: int = 10) -> DataFrame:
    """(variable, n_distinct, kind): binary (values within {0,1}), discrete (few distinct values) or continuous, for
    which n_distinct is NULL. NULLs count as no value; tasks send at most discrete_max + 1 values of a column."""
    values = few_values(df, features, discrete_max + 1).groupBy("variable").agg(
        F.count_distinct("key").alias("n"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("is01"))
    few = F.col("n") <= discrete_max
    return values.select(
        "variable", F.when(few | F.col("is01"), F.col("n")).alias("n_distinct"),
        F.when(F.col("is01"), "binary").when(few, "discrete").otherwise("continuous").alias("kind"))


def binary_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Columns whose non-null values stay within {0, 1} (one cheap scan, no distinct)."""
    row = df.agg(*[F.bool_and(F.col(c).isin(0, 1) | F.col(c).isNull()).alias(c) for c in features]).first()
    return [c for c in features if row[c]]


# ---- association -----------------------------------------------------------------------------

def pearson_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(i, j, a, b, r) for i < j; NULL r where a side is constant. Only the p x p matrix leaves Spark."""
    vec = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df).select("_v")
    m = Correlation.corr(vec, "_v").head()[0].toArray()
    rows = [
        (i, j, features[i], features[j], None if m[i, j] != m[i, j] else float(m[i, j]))
        for i in range(len(features)) for j in range(i + 1, len(features))
    ]
    return df.sparkSession.createDataFrame(rows, "i int, j int, a string, b string, r double")


def correlated_pairs(df: DataFrame, features: Sequence[str], limit: float = 0.90) -> DataFrame:
    return pearson_pairs(df, features).filter(F.abs("r") > limit)


def _corr(x: Column, y: Column) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_with_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Correlation with the label over the rows where the variable is present; NULL for constants."""
    def r(c: Column) -> Column:
        y = F.when(c.isNotNull(), F.col(label).cast("double"))
        return _corr(c.cast("double"), y)

    return column_aggregate(df, features, {"r": r}, buffers_each=10)


def spearman_with_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rank correlation with a binary label from value histograms (exact, ties averaged).

    Ranks are taken over the rows where the variable is present; the label's ranks only take two
    values, so its rank correlation equals the Pearson correlation of ranks with the 0/1 label.
    """
    cells = long_form(df, features, [label]).filter(F.col("value").isNotNull())
    hist = cells.groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos"))
    ranked = average_ranks(hist, ["variable"])
    r, n, pos = F.col("avg_rank"), F.col("n"), F.col("pos")
    s = ranked.groupBy("variable").agg(
        F.sum(n).cast("double").alias("n"), F.sum(pos).cast("double").alias("p"),
        F.sum(n * r).alias("sr"), F.sum(pos * r).alias("spr"),
    )
    centred = ranked.join(F.broadcast(s), "variable").groupBy("variable", s["n"].alias("nn"), s["p"].alias("pp")).agg(
        F.sum(ranked["n"] * (r - (s["n"] + 1) / 2.0) * (r - (s["n"] + 1) / 2.0)).alias("srr"),
        F.sum(ranked["pos"] * (r - (s["n"] + 1) / 2.0)).alias("srp"),
    )
    var_label = F.col("pp") - F.col("pp") * F.col("pp") / F.col("nn")
    return centred.select("variable", F.try_divide(F.col("srp"), F.sqrt(F.col("srr") * var_label)).alias("rho"))


def bin_by_quantiles(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(variable, bin, label, n) on exact quantile bins; NULL is its own bin (-1)."""
    edges = exact_quantiles(df, features, [i / bins for i in range(1, bins)]).groupBy("variable").agg(
        F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))
    cells = long_form(df, features, [label])
    hist = cells.groupBy("variable", "value", label).agg(F.count(F.lit(1)).alias("n"))
    placed = locate(hist.join(F.broadcast(edges), "variable", "left"), "edges", F.col("value"), bins, "slot")
    b = F.when(F.col("value").isNull(), -1).otherwise(F.col("slot"))
    return placed.groupBy("variable", b.alias("bin"), label).agg(F.sum("n").alias("n"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) with the class on quantile bins, over all rows.

    A re-aimed estimator: it answers the nearest-neighbour estimator's question on the full data
    instead of a sample, so the values differ and the ranking is what compares.
    """
    n = bin_by_quantiles(df, features, label, bins)
    by_bin, by_label, by_var = (Window.partitionBy("variable", "bin"), Window.partitionBy("variable", label),
                                Window.partitionBy("variable"))
    c = n.select(
        "variable", F.col("n").cast("double").alias("n"),
        F.sum("n").over(by_bin).cast("double").alias("nb"), F.sum("n").over(by_label).cast("double").alias("nl"),
        F.sum("n").over(by_var).cast("double").alias("t"))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("nl")))
    return c.groupBy("variable").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F of each variable against the class; NULL where no within-class variance is left."""
    per = df.groupBy(label).agg(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count(c).cast("double").alias("n"),
                 F.avg(c).alias("m"), F.var_pop(c).alias("v")) for c in features
    ]).alias("a")).select(label, F.inline("a")).filter(F.col("n") > 0)
    grand = per.groupBy("variable").agg(
        F.sum("n").alias("nt"), F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"))
    ssb = per.join(F.broadcast(grand), "variable").groupBy("variable", "nt", "k", "ssw").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"))
    return ssb.select("variable", F.try_divide(
        F.try_divide(F.col("ssb"), (F.col("k") - 1).cast("double")),
        F.try_divide(F.col("ssw"), F.col("nt") - F.col("k"))).alias("f"))


def ranking_table(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mi"), "variable")
    both = anova_f(df, features, label).join(mutual_information(df, features, label, bins), "variable")
    return both.withColumn("position", F.row_number().over(w))


# ---- outliers and class profiles -------------------------------------------------------------

def _fences(df: DataFrame, features: Sequence[str], k: float) -> dict[str, tuple[float, float]]:
    quart: dict[str, dict[float, float]] = {}
    for r in exact_quantiles(df, features, [0.25, 0.75]).collect():  # two rows per column
        quart.setdefault(r["variable"], {})[r["p"]] = r["q"]
    return {c: (q[0.25] - k * (q[0.75] - q[0.25]), q[0.75] + k * (q[0.75] - q[0.25]))
            for c, q in quart.items()}


def iqr_outliers(df: DataFrame, features: Sequence[str], k: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(summary row, per-column share): rows with any value outside the fences, and cells."""
    fences = _fences(df, features, k)
    cols = [c for c in features if c in fences]
    flag = {c: F.coalesce((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1]), F.lit(False)) for c in cols}
    flags = df.select(*[flag[c].cast("int").alias(c) for c in cols])
    cells = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    summary = flags.select(cells.alias("hits")).agg(
        (F.avg((F.col("hits") > 0).cast("double")) * 100).alias("pct_rows"),
        (F.avg(F.col("hits").cast("double")) * 100 / len(cols)).alias("pct_cells"))
    per_column = column_aggregate(flags, cols, {"pct": lambda c: F.avg(c) * 100}, buffers_each=2)
    return summary, per_column


def medians_by_class(df: DataFrame, features: Sequence[str], label: str, classes: Sequence) -> DataFrame:
    m = exact_medians(df, features, [label])
    return m.groupBy("variable").pivot(label, list(classes)).agg(F.first("median")).select(
        "variable", *[F.col(str(c)).alias(f"median_{c}") for c in classes])


def class_profile(df: DataFrame, features: Sequence[str], label: str, value=0) -> DataFrame:
    """Median profile of one class, (variable, median)."""
    return exact_medians(df.filter(F.col(label) == value), features)


def crosstab(df: DataFrame, row: str | Column, col: str, values: Sequence, prefix: str = "n_") -> DataFrame:
    out = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return out.select(out.columns[0], *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"{prefix}{v}") for v in values])


def binned_crosstab(
    df: DataFrame, value: str, label: str, classes: Sequence, edges: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Share (%) of each class falling in each right-closed bin; columns add up to 100."""
    binned = df.withColumn("bin", right_closed_bin(F.col(value), edges, names)).filter(F.col("bin").isNotNull())
    tab = crosstab(binned, "bin", label, classes)
    w = Window.partitionBy(F.lit(0))
    return tab.select("bin", *[
        (F.col(f"n_{c}") * 100.0 / F.sum(f"n_{c}").over(w)).alias(f"pct_{c}") for c in classes])


def share_by_class(
    df: DataFrame, features: Sequence[str], label: str, predicate, name: str = "pct"
) -> DataFrame:
    """(variable, class, n, pct): how often a predicate holds per column and class."""
    per = df.groupBy(label).agg(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count_if(predicate(F.col(c))).alias("n"),
                 (F.count_if(predicate(F.col(c))) * 100.0 / F.count(F.lit(1))).alias(name)) for c in features
    ]).alias("a"))
    return per.select(label, F.inline("a"))


def zero_share(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return share_by_class(df, features, label, lambda c: c == 0)


def presence_share(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return share_by_class(df, features, label, lambda c: c > 0)


def emptiness_by_class(df: DataFrame, label: str, flags: Mapping[str, Column]) -> DataFrame:
    """(class, indicator, pct) for named boolean row conditions."""
    per = df.groupBy(label).agg(F.array(*[
        F.struct(F.lit(k).alias("indicator"), (F.avg(f.cast("int")) * 100).alias("pct")) for k, f in flags.items()
    ]).alias("a"))
    return per.select(label, F.inline("a"))


# ---- leakage audit ---------------------------------------------------------------------------

# The reference protocol's cut grid, 50 quantiles evenly spaced from 1 % to 99 %.
CUT_PROBS = tuple(0.01 + 0.98 * i / 49 for i in range(50))


def single_cuts(df: DataFrame, features: Sequence[str], label: str, probs: Sequence[float] = CUT_PROBS) -> DataFrame:
    """(variable, cut, acc_ge, acc_lt): accuracy of every one-cut rule, in both directions.

    Rows are counted once per (variable, interval between cuts); the accuracy of each cut is a
    suffix sum over those few counts. A NULL compares false in both directions.
    """
    cuts = exact_quantiles(df, features, list(probs)).groupBy("variable").agg(
        F.array_sort(F.array_distinct(F.collect_list("q"))).alias("cuts"))
    cells = long_form(df, features, [label])
    placed = locate(cells.join(F.broadcast(cuts), "variable"), "cuts", F.col("value"), len(probs), "slot", inclusive=True)
    at_or_above = F.when(F.col("value").isNull(), -1).otherwise(F.col("slot"))
    binned = placed.groupBy("variable", "cuts", at_or_above.alias("b")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(~F.coalesce(F.col(label) == 1, F.lit(False))).alias("neg"))
    per = binned.groupBy("variable", "cuts").agg(
        F.collect_list(F.struct("b", "pos", "neg")).alias("h"),  # at most one entry per cut interval
        F.sum("pos").alias("p"), F.sum("neg").alias("q"),
        F.sum(F.when(F.col("b") >= 0, 1).otherwise(0)).alias("bins"))
    varied = per.filter(F.size("cuts") >= 1)
    ex = varied.select("variable", "h", "p", "q", F.posexplode("cuts").alias("i", "cut"))

    def suffix(field: str, upper: bool) -> Column:
        keep = (lambda s: s["b"] > F.col("i")) if upper else (lambda s: (s["b"] >= 0) & (s["b"] <= F.col("i")))
        return F.aggregate(F.filter("h", keep), F.lit(0).cast("bigint"), lambda acc, s: acc + s[field])

    total = F.col("p") + F.col("q")
    return ex.select(
        "variable", "cut",
        ((suffix("pos", True) + F.col("q") - suffix("neg", True)) / total).alias("acc_ge"),
        ((suffix("pos", False) + F.col("q") - suffix("neg", False)) / total).alias("acc_lt"))


def best_cut_per_variable(df: DataFrame, features: Sequence[str], label: str,
                          probs: Sequence[float] = CUT_PROBS) -> DataFrame:
    """(variable, accuracy) of the best one-cut rule; single-valued columns are left out."""
    spread = column_aggregate(df, features, {"lo": lambda c: F.min(c), "hi": lambda c: F.max(c)})
    varied = spread.filter(F.col("lo") < F.col("hi")).select("variable")
    cuts = single_cuts(df, features, label, probs).join(F.broadcast(varied), "variable", "left_semi")
    return cuts.groupBy("variable").agg(F.max(F.greatest("acc_ge", "acc_lt")).alias("accuracy"))


def best_single_cut(df: DataFrame, features: Sequence[str], label: str,
                    probs: Sequence[float] = CUT_PROBS) -> DataFrame:
    """The one best (variable, accuracy); the earlier column wins ties."""
    order = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("variable"))
    ranked = best_cut_per_variable(df, features, label, probs).withColumn("_o", order)
    return ranked.orderBy(F.desc("accuracy"), "_o").limit(1).drop("_o")


def constant_in_class(df: DataFrame, features: Sequence[str], label: str, min_rows: int = 0) -> DataFrame:
    """(variable, constant_class, value, n_differs, pct_differs): columns fixed inside one class.

    n_differs and pct_differs describe the other class's non-null values.
    """
    per = df.groupBy(label).agg(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.min(c).cast("double").alias("lo"),
                 F.max(c).cast("double").alias("hi")) for c in features
    ]).alias("a")).select(label, F.inline("a"))
    const = per.filter((F.col("lo") == F.col("hi")) & (F.col("n") > min_rows)).select(
        "variable", F.col(label).alias("constant_class"), F.col("lo").alias("const"))
    cells = long_form(df, features, [label]).filter(F.col("value").isNotNull())
    other = cells.join(F.broadcast(const), ["variable"]).filter(F.col(label) != F.col("constant_class"))
    return other.groupBy("variable", "constant_class", F.col("const").alias("value")).agg(
        F.count_if(F.col("value") != F.col("const")).alias("n_differs"), F.count(F.lit(1)).alias("n_other"),
    ).select("variable", "constant_class", "value", "n_differs",
             (F.col("n_differs") * 100.0 / F.col("n_other")).alias("pct_differs"))


def degenerate_features(df: DataFrame, features: Sequence[str], label: str, min_rows: int = 100) -> DataFrame:
    """Constant inside one class, and less than half of the other class takes that value."""
    return constant_in_class(df, features, label, min_rows).filter(F.col("pct_differs") > 50.0)


def rule_accuracy(df: DataFrame, condition: Column, label: str, positive: int = 1) -> DataFrame:
    """Accuracy of 'condition implies class' as a complete classifier."""
    return df.agg(F.avg((condition == (F.col(label) == positive)).cast("int")).alias("accuracy"),
                  F.count(F.lit(1)).alias("rows"))


def profile_summary(df: DataFrame, features: Sequence[str], label: str, sentinel: float = -1.0,
                    corr_limit: float = 0.90, null_corr_limit: float = 0.95) -> DataFrame:
    """The exploration summary as one row, from the operators above."""
    from tabsieve.operators.clean import duplicate_report, sentinel_to_null

    sent = sentinel_profile(df, features, sentinel).agg(
        F.count(F.lit(1)).alias("sentinel_columns"), F.coalesce(F.sum("n"), F.lit(0)).alias("sentinel_cells"))
    kinds = constancy(df, features).agg(
        F.count_if(F.col("kind") == "constant").alias("constant"),
        F.count_if(F.col("kind") == "quasi_constant").alias("quasi_constant"))
    binary = variable_types(df, features).agg(F.count_if(F.col("kind") == "binary").alias("binary"))
    pairs = correlated_pairs(df, features, corr_limit).agg(F.count(F.lit(1)).alias("correlated_pairs"))
    co = null_cooccurrence(sentinel_to_null(df, features, sentinel), features).filter(
        F.abs("r") > null_corr_limit).agg(F.count(F.lit(1)).alias("comissing_pairs"))
    dup = duplicate_report(df, features, label)
    out = dup
    for part in (sent, kinds, binary, pairs, co):  # one-row tables
        out = out.join(F.broadcast(part))
    return out


def confusion_cell_means(preds: DataFrame, features: Sequence[str], cell: str = "cell") -> DataFrame:
    """(variable, mean_FN, mean_FP, mean_TN, mean_TP)."""
    cells = ["FN", "FP", "TN", "TP"]
    per = preds.groupBy(cell).agg(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.avg(c).alias("m")) for c in features]).alias("a"))
    return per.select(cell, F.inline("a")).groupBy("variable").pivot(cell, cells).agg(F.first("m")).select(
        "variable", *[F.col(c).alias(f"mean_{c}") for c in cells])


def fold_summary(scores: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def seed_summary(scores: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation and range over seeds."""
    return scores.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        (F.max(value) - F.min(value)).alias("range"))


def winner_counts(scores: DataFrame, group: str, seed: str, item: str, value: str, decimals: int = 4) -> DataFrame:
    """Per comparison: how many seeds each item wins outright or shares, after rounding."""
    w = Window.partitionBy(group, seed)
    m = F.round(value, decimals)
    marked = scores.select(group, seed, item, m.alias("m"), F.max(m).over(w).alias("best")).filter(
        F.col("m") == F.col("best"))
    tied = marked.withColumn("n_best", F.count(F.lit(1)).over(w))
    return tied.groupBy(group, item).agg(
        F.count_if(F.col("n_best") == 1).alias("wins"), F.count_if(F.col("n_best") > 1).alias("ties"))

