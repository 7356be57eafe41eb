"""Queries: splits, samples, imputation, scaling, selection and decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.operators import choose as ch
from tabsieve.operators import preprocess as pp
from tabsieve.operators import profile as pr
from tabsieve.operators import select as se
from tabsieve.operators import split as sp
from tabsieve.plans import fixtures as fx
from tabsieve.plans.profiling import SQL_BINS, SQL_SCORES, fold_scores, rnd
from tabsieve.plans.registry import query
from tabsieve.session import ensure_checkpoint_dir

M, N, S = fx.SQL_MAIN, fx.SQL_NULL, fx.SQL_SPLIT
ORDER = "md5(concat_ws('|', '{seed}', row_id))"


# ---- splits ----------------------------------------------------------------------------------

@query("x01_stratified_holdout", fx.with_sql(M, N, S, body="SELECT row_id, label, split FROM fsplit"))
def x01(spark: SparkSession, sf: str) -> DataFrame:
    return fx.split_main(spark, sf).select("row_id", "label", "split")


@query("x02_stratified_sample", fx.with_sql(M, body=f"""
SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format(seed=42)}) AS rn,
  count(*) OVER (PARTITION BY label) AS nl, count(*) OVER () AS n FROM fmain)
WHERE rn <= least(nl, round(nl * 6000.0::DOUBLE / n))"""))
def x02(spark: SparkSession, sf: str) -> DataFrame:
    return sp.stratified_sample(fx.main_raw(spark, sf).select("row_id", "label"), "label", 6000)


def _fold_sql(seed: int, k: int, extra: str = "") -> str:
    return (f"SELECT row_id, label{extra}, CAST((CASE " + " ".join(
        f"WHEN rn <= floor(nl * {i} / {k}.0) THEN {i - 1}" for i in range(1, k)) + f" ELSE {k - 1} END) AS INTEGER) AS fold FROM ("
        f"SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format(seed=seed)}) AS rn, "
        "count(*) OVER (PARTITION BY label) AS nl FROM fmain)")


@query("x03_stratified_kfold", fx.with_sql(M, body=_fold_sql(42, 5)))
def x03(spark: SparkSession, sf: str) -> DataFrame:
    return sp.stratified_kfold(fx.main_raw(spark, sf).select("row_id", "label"), "label", 5)


@query("x04_repeated_kfold", fx.with_sql(M, body=" UNION ALL ".join(
    _fold_sql(42 + r, 5, f", CAST({r} AS INTEGER) AS repeat") for r in range(3))))
def x04(spark: SparkSession, sf: str) -> DataFrame:
    return sp.repeated_kfold(fx.main_raw(spark, sf).select("row_id", "label"), "label", 5, 3)


@query("x05_uniform_sample", fx.with_sql(M, body=f"SELECT row_id, label FROM fmain ORDER BY {ORDER.format(seed=42)} LIMIT 1200"))
def x05(spark: SparkSession, sf: str) -> DataFrame:
    return sp.sample_rows(fx.main_raw(spark, sf).select("row_id", "label"), 1200)


@query("x06_sample_per_seed", fx.with_sql(M, body=" UNION ALL ".join(
    f"(SELECT row_id, CAST({s} AS INTEGER) AS seed FROM fmain ORDER BY {ORDER.format(seed=s)} LIMIT 700)" for s in (1, 2, 3))))
def x06(spark: SparkSession, sf: str) -> DataFrame:
    return sp.sample_rows_seeds(fx.main_raw(spark, sf).select("row_id"), 700, [1, 2, 3])


@query("x07_bootstrap_weights")
def x07(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_raw(spark, sf).select("row_id", "label")
    w = m.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "w", sp.bootstrap_weight(F.col("replicate"), F.col("row_id")))
    return w.groupBy("replicate", "label").agg(F.sum("w").alias("drawn"), F.count(F.lit(1)).alias("rows"))


SQL_SHIFT = """fshift AS (SELECT m.*, CASE WHEN f_age >= cut THEN 'train' ELSE 'shifted' END AS part
  FROM fnull m, (SELECT quantile_cont(f_age, 0.7) AS cut FROM fnull))"""


@query("x08_calibration_split", fx.with_sql(M, N, SQL_SHIFT, body=f"""
SELECT label, use, count(*) AS n FROM (
  SELECT label, CASE WHEN rn <= round(nl * 0.3) THEN 'calibrate' ELSE 'measure' END AS use FROM (
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format(seed=42)}) AS rn,
      count(*) OVER (PARTITION BY label) AS nl FROM fshift WHERE part = 'shifted')) GROUP BY label, use"""))
def x08(spark: SparkSession, sf: str) -> DataFrame:
    shifted = sp.shift_split(fx.main_null(spark, sf), "f_age").filter("part = 'shifted'").select("row_id", "label")
    tagged = sp.stratified_holdout(shifted, "label", 0.3, name="use", first="calibrate", rest="measure")
    return tagged.groupBy("label", "use").agg(F.count(F.lit(1)).alias("n"))


@query("x09_shift_split", fx.with_sql(M, N, SQL_SHIFT, body="SELECT row_id, part FROM fshift"))
def x09(spark: SparkSession, sf: str) -> DataFrame:
    return sp.shift_split(fx.main_null(spark, sf), "f_age").select("row_id", "part")


_SHARES = [0.1 + 0.9 * i / 5 for i in range(5)]


@query("x10_learning_sizes", fx.with_sql(M, body="SELECT label, step, count(*) AS n FROM (SELECT label, CAST(CASE " + " ".join(
    f"WHEN rn <= floor(round(nl * {s!r}::DOUBLE, 6)) THEN {i + 1}" for i, s in enumerate(_SHARES)) + f""" ELSE 6 END AS INTEGER) AS step FROM (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format(seed=42)}) AS rn,
    count(*) OVER (PARTITION BY label) AS nl FROM fmain)) GROUP BY label, step"""))
def x10(spark: SparkSession, sf: str) -> DataFrame:
    tagged = sp.learning_sizes(fx.main_raw(spark, sf).select("row_id", "label"), "label")
    return tagged.groupBy("label", "step").agg(F.count(F.lit(1)).alias("n"))


@query("x10_absolute_sizes", fx.with_sql(M, body=f"""
SELECT size, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM (
  SELECT label, CAST(CASE WHEN rn <= 500 THEN 500 WHEN rn <= 2000 THEN 2000 WHEN rn <= 10000 THEN 10000 END AS INTEGER) AS size
  FROM (SELECT label, row_number() OVER (ORDER BY {ORDER.format(seed=42)}) AS rn FROM fmain)) WHERE size IS NOT NULL GROUP BY size"""))
def x10b(spark: SparkSession, sf: str) -> DataFrame:
    tagged = sp.absolute_sizes(fx.main_raw(spark, sf).select("row_id", "label"), [500, 2000, 10000])
    return tagged.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


# ---- imputation ------------------------------------------------------------------------------

HOLES = ["f_age", "f_age2"]


def _impute_sql(expr: str, flags: bool = False) -> str:
    cols = []
    for c in HOLES:
        cols.append(f"round(avg(coalesce({c}, s_{c})), 6) AS {c}")
        cols.append(f"count(*) - count(coalesce({c}, s_{c})) AS left_{c}")
        if flags:
            cols.append(f"CAST(sum(CAST({c} IS NULL AS INTEGER)) AS DOUBLE) AS flag_{c}")
    stats = ", ".join(f"{expr.format(c=c)} AS s_{c}" for c in HOLES)
    return fx.with_sql(M, N, S, body=f"SELECT split, {', '.join(cols)} FROM fsplit, (SELECT {stats} FROM fsplit "
                       "WHERE split = 'train') GROUP BY split")


def _split_stage(spark: SparkSession, sf: str) -> DataFrame:
    """The split as a finished stage: fitting and transforming read it, not the plan behind it."""
    ensure_checkpoint_dir(spark)
    return fx.split_main(spark, sf).checkpoint()


def _impute(spark: SparkSession, sf: str, strategy: str, flags: bool = False) -> DataFrame:
    df = _split_stage(spark, sf)
    model = pp.ColumnImputer(fx.FEATURES, strategy, indicators=flags).fit(df.filter("split = 'train'"))
    measures = []
    for c in HOLES:
        measures.append(F.round(F.avg(c), 6).alias(c))
        measures.append(F.count_if(F.col(c).isNull()).alias(f"left_{c}"))
        if flags:
            measures.append(F.sum(f"missingindicator_{c}").alias(f"flag_{c}"))
    return model.transform(df).groupBy("split").agg(*measures)


@query("i01_mean_impute", _impute_sql("avg({c})"))
def i01(spark: SparkSession, sf: str) -> DataFrame:
    return _impute(spark, sf, "mean")


@query("i02_median_impute", _impute_sql("median({c})"))
def i02(spark: SparkSession, sf: str) -> DataFrame:
    return _impute(spark, sf, "median")


_MODE = "(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM fsplit WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1))"


@query("i03_most_frequent_impute", _impute_sql("any_value(" + _MODE + ")"))
def i03(spark: SparkSession, sf: str) -> DataFrame:
    return _impute(spark, sf, "most_frequent")


@query("i04_constant_impute", _impute_sql("CAST(any_value(-1) AS DOUBLE)"))
def i04(spark: SparkSession, sf: str) -> DataFrame:
    return _impute(spark, sf, "constant")


@query("i05_median_and_indicators", _impute_sql("median({c})", flags=True))
def i05(spark: SparkSession, sf: str) -> DataFrame:
    return _impute(spark, sf, "median", flags=True)


@query("i06_mean_and_indicators", _impute_sql("avg({c})", flags=True))
def i06(spark: SparkSession, sf: str) -> DataFrame:
    return _impute(spark, sf, "mean", flags=True)


@query("i08_iterative_impute")
def i08(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.clean import require_no_nulls

    df = fx.main_null(spark, sf).select("row_id", "label", "f_qty", "f_price", "f_disc", "f_age", "f_age2")
    features = ["f_qty", "f_price", "f_disc", "f_age", "f_age2"]
    filled = pp.IterativeImputer(features).fit(df).transform(df)
    require_no_nulls(filled, features)
    return filled.agg(*[F.avg(c).alias(c) for c in features])


@query("i09_null_bin_encoding", fx.with_sql(M, N, body="""
SELECT code, count(*) AS n FROM (SELECT CAST(CASE WHEN f_age IS NULL THEN 0 WHEN f_age <= q1 THEN 1 WHEN f_age <= q2 THEN 2
  WHEN f_age <= q3 THEN 3 ELSE 4 END AS DOUBLE) AS code FROM fnull,
  (SELECT quantile_cont(f_age, 0.25) AS q1, quantile_cont(f_age, 0.5) AS q2, quantile_cont(f_age, 0.75) AS q3 FROM fnull)) GROUP BY code"""))
def i09(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.main_null(spark, sf).select("f_age")
    return pp.NullBinEncoder(["f_age"], bins=4).fit(df).transform(df).groupBy(F.col("f_age").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))


_MEDIANS = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in fx.FEATURES)
_LEFT = " + ".join(f"CAST(coalesce(s.{c}, m.{c}) IS NULL AS BIGINT)" for c in fx.FEATURES)


@query("i10_no_nulls_left", fx.with_sql(M, N, S, f"m AS (SELECT {_MEDIANS} FROM fsplit WHERE split = 'train')", body=f"""
SELECT count(*) AS n, CAST(sum({_LEFT}) AS BIGINT) AS nulls FROM fsplit s, m"""))
def i10(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.clean import require_no_nulls

    df = fx.split_main(spark, sf)
    filled = pp.ColumnImputer(fx.FEATURES, "median").fit(df.filter("split = 'train'")).transform(df)
    left = sum((F.col(c).isNull().cast("int") for c in fx.FEATURES[1:]), F.col(fx.FEATURES[0]).isNull().cast("int"))
    return require_no_nulls(filled, fx.FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum(left).alias("nulls"))


# ---- scaling ---------------------------------------------------------------------------------

SCALED = ["f_qty", "f_price", "f_disc", "f_tax"]


def _scale_sql(shift: str, scale: str) -> str:
    stats = ", ".join(f"CAST({shift.format(c=c)} AS DOUBLE) AS a_{c}, CAST({scale.format(c=c)} AS DOUBLE) AS b_{c}" for c in SCALED)
    cols = ", ".join(f"round(avg(({c} - a_{c}) / b_{c}), 5) + 0.0::DOUBLE AS {c}, round(max(({c} - a_{c}) / b_{c}), 6) AS max_{c}" for c in SCALED)
    return fx.with_sql(M, N, S, body=f"SELECT split, {cols}, avg(f_bin) IS NOT NULL AS kept FROM fsplit, (SELECT {stats} "
                       "FROM fsplit WHERE split = 'train') GROUP BY split")


def _scale(spark: SparkSession, sf: str, method: str) -> DataFrame:
    df = _split_stage(spark, sf)
    model = pp.ColumnScaler([*SCALED, "f_bin", "f_quasi"], method).fit(df.filter("split = 'train'"))
    out = model.transform(df).groupBy("split").agg(
        *[F.avg(c).alias(c) for c in SCALED], *[F.round(F.max(c), 6).alias(f"max_{c}") for c in SCALED],
        F.bool_and(F.col("f_bin").isin(0.0, 1.0)).alias("kept"))
    return rnd(out, *SCALED, d=5)


@query("e01_no_scaling", _scale_sql("any_value(0)", "any_value(1)"))
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return _scale(spark, sf, "none")


@query("e02_standard_scaler", _scale_sql("avg({c})", "stddev_pop({c})"))
def e02(spark: SparkSession, sf: str) -> DataFrame:
    return _scale(spark, sf, "standard")


@query("e03_minmax_scaler", _scale_sql("min({c})", "max({c}) - min({c})"))
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return _scale(spark, sf, "minmax")


@query("e04_robust_scaler", _scale_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def e04(spark: SparkSession, sf: str) -> DataFrame:
    return _scale(spark, sf, "robust")


@query("e05_maxabs_scaler", _scale_sql("any_value(0)", "max(abs({c}))"))
def e05(spark: SparkSession, sf: str) -> DataFrame:
    return _scale(spark, sf, "maxabs")


@query("e06_yeo_johnson")
def e06(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.main_raw(spark, sf).select("label", *SCALED)
    scaled = pp.ColumnScaler(SCALED, "yeo_johnson").fit(df).transform(df)
    return scaled.agg(*[F.avg(c).alias(c) for c in SCALED], *[F.stddev_pop(c).alias(f"sd_{c}") for c in SCALED])


@query("e07_continuous_only", fx.with_sql(M, body="""
SELECT round(avg(f_bin), 6) AS f_bin, round(avg(f_quasi), 6) AS f_quasi, round(avg((f_qty - mu) / sd), 6) + 0.0::DOUBLE AS f_qty,
  round(stddev_pop((f_qty - mu) / sd), 6) AS sd_qty FROM fmain, (SELECT avg(f_qty) AS mu, stddev_pop(f_qty) AS sd FROM fmain)"""))
def e07(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.main_raw(spark, sf)
    out = pp.ColumnScaler(["f_bin", "f_quasi", "f_qty"], "standard").fit(df).transform(df).agg(
        F.avg("f_bin").alias("f_bin"), F.avg("f_quasi").alias("f_quasi"), F.avg("f_qty").alias("f_qty"),
        F.stddev_pop("f_qty").alias("sd_qty"))
    return rnd(out, "f_bin", "f_quasi", "f_qty", "sd_qty")


# ---- selection -------------------------------------------------------------------------------

LONG = fx.long_sql("fmain")


def _names(spark: SparkSession, df: DataFrame, kept: list[str]) -> DataFrame:
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return spark.createDataFrame([(c,) for c in kept], "variable string").join(F.broadcast(rows))


@query("k01_variance_filter", fx.with_sql(M, LONG, body="""
SELECT variable, (SELECT count(*) FROM fmain) AS rows FROM (SELECT variable, value, count(*) AS n FROM long GROUP BY variable, value)
GROUP BY variable HAVING max(n) / CAST(sum(n) AS DOUBLE) < 0.98"""))
def k01(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_raw(spark, sf)
    return _names(spark, m, se.variance_filter(m, fx.FEATURES, 0.98))


@query("k02_correlation_pruning", fx.with_sql(M, body="SELECT variable, (SELECT count(*) FROM fmain) AS rows FROM (VALUES "
       + ", ".join(f"('{c}')" for c in fx.FEATURES) + ") t(variable) WHERE variable NOT IN ("
       + " UNION ALL ".join(f"SELECT '{b}' FROM fmain HAVING stddev_pop({a}) * stddev_pop({b}) > 0 AND abs(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)) > 0.85"
                            for i, a in enumerate(fx.FEATURES) for b in fx.FEATURES[i + 1:]) + ")"))
def k02(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_raw(spark, sf)
    return _names(spark, m, se.prune_correlated(m, fx.FEATURES, 0.85))


# ---- sorts, top-k, decision rules ------------------------------------------------------------

SQL_MEANS = SQL_SCORES + """,
comp AS (SELECT 'm' || fold AS model, round(avg(value), 4) AS f1_mean, count(*) AS size FROM scores GROUP BY fold)"""


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    """A comparison table (model, f1_mean, size) derived from the main table."""
    s = fold_scores(spark, sf)
    return s.groupBy(F.concat(F.lit("m"), F.col("fold").cast("string")).alias("model")).agg(
        F.round(F.avg("value"), 4).alias("f1_mean"), F.count(F.lit(1)).alias("size"))


@query("t01_sort_two_keys", fx.with_sql(M, SQL_MEANS, body="SELECT CAST(row_number() OVER (ORDER BY f1_mean DESC, model) AS INTEGER) AS position, model, f1_mean FROM comp"))
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return ch.profile_positions(comparison(spark, sf), "f1_mean", "model").select("position", "model", "f1_mean")


@query("t02_top_k", fx.with_sql(M, body="SELECT row_id, f_price FROM fmain ORDER BY f_price DESC, row_id LIMIT 15"))
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return ch.top_k(fx.main_raw(spark, sf).select("row_id", "f_price"), 15, F.desc("f_price"), "row_id")


@query("t03_arg_max", fx.with_sql(M, body="""
SELECT label, arg_max(row_id, f_price) AS row_id, max(f_price) AS f_price FROM fmain GROUP BY label"""))
def t03(spark: SparkSession, sf: str) -> DataFrame:
    return ch.arg_best(fx.main_raw(spark, sf), "row_id", "f_price", by=["label"])


@query("t04_declared_choice", fx.with_sql(M, SQL_MEANS, body="""
SELECT model, best, n_tied, 'f1_mean = ' || printf('%.2f', best) || CASE WHEN n_tied > 1 THEN '; tie broken by declared order' ELSE '' END AS reason
FROM (SELECT model, best, count(*) OVER () AS n_tied, CAST(replace(model, 'm', '') AS INTEGER) AS p FROM (
  SELECT model, round_even(f1_mean, 2) AS m, max(round_even(f1_mean, 2)) OVER () AS best FROM comp) WHERE m = best) ORDER BY p DESC LIMIT 1"""))
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return ch.choose(comparison(spark, sf), "model", "f1_mean", [f"m{i}" for i in range(10, -1, -1)], decimals=2)


@query("t05_parsimony_rule", fx.with_sql(M, SQL_SCORES, body="""
SELECT model, size, f1_mean FROM (SELECT model, CAST(substr(model, 2) AS INTEGER) AS size, round(avg(value), 6) AS f1_mean,
  max(round(avg(value), 6)) OVER () AS best FROM scores GROUP BY model) WHERE f1_mean >= best - 0.01 ORDER BY size, f1_mean DESC LIMIT 1"""))
def t05(spark: SparkSession, sf: str) -> DataFrame:
    s = fold_scores(spark, sf).groupBy("model").agg(F.round(F.avg("value"), 6).alias("f1_mean")).withColumn(
        "size", F.substring("model", 2, 5).cast("int"))
    return ch.most_parsimonious(s, "model", "f1_mean", "size", 0.01)


@query("w02_best_so_far", fx.with_sql(M, SQL_SCORES, body="""
SELECT model, fold, value, max(value) OVER (PARTITION BY model ORDER BY fold ROWS UNBOUNDED PRECEDING) AS best_so_far FROM scores"""))
def w02(spark: SparkSession, sf: str) -> DataFrame:
    return ch.best_so_far(fold_scores(spark, sf), "fold", "value", by=["model"])


@query("w04_average_ranks", fx.with_sql(M, body="""
SELECT f_price AS value, count(*) AS n, min(r) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank FROM (
  SELECT f_price, rank() OVER (ORDER BY f_price) AS r FROM fmain) GROUP BY f_price"""))
def w04(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.distribution import average_ranks, value_histogram

    hist = value_histogram(fx.main_raw(spark, sf), ["f_price"])
    return average_ranks(hist, ["variable"]).select("value", "n", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("w06_sorted_profile", fx.with_sql(M, LONG, """nl AS (SELECT variable, round(count(*) FILTER (WHERE value = 0) * 100.0 / count(*), 4) AS pct
  FROM long GROUP BY variable)""", body="""
SELECT variable, pct, CAST(row_number() OVER (ORDER BY pct DESC, variable) AS INTEGER) AS position,
  count(*) FILTER (WHERE pct >= 10) OVER () AS n_above FROM nl"""))
def w06(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.distribution import column_aggregate

    z = column_aggregate(fx.main_raw(spark, sf), fx.FEATURES, {
        "pct": lambda c: F.round(F.count_if(c == 0) * 100.0 / F.count(F.lit(1)), 4)}, 2)
    above = z.agg(F.count_if(F.col("pct") >= 10).alias("n_above"))
    return ch.profile_positions(z, "pct", "variable").join(F.broadcast(above))


@query("h07_consensus", fx.with_sql(M, N, fx.long_sql("fnull"), SQL_BINS, """
dom AS (SELECT variable, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS d FROM (
  SELECT variable, value, count(*) AS n FROM long GROUP BY variable, value) GROUP BY variable),
a AS (SELECT variable, mi FROM mi ORDER BY mi DESC, variable LIMIT 6), b AS (SELECT variable FROM dom ORDER BY d DESC, variable LIMIT 8)""",
    body="SELECT variable, mi FROM a WHERE variable IN (SELECT variable FROM b)"))
def h07(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_null(spark, sf)
    mi = rnd(pr.mutual_information(m, fx.FEATURES, "label"), "mi")
    dom = rnd(pr.dominance(m, fx.FEATURES), "dominance")
    first = ch.top_k(mi, 6, F.desc("mi"), "variable")
    return ch.consensus(first, dom, "variable", "mi", "dominance", k=8)


@query("h08_parameter_importance", fx.with_sql(M, """
tr AS (SELECT CAST(f_disc * 100 AS INTEGER) AS p1, CAST(f_line AS INTEGER) AS p2, round(avg(f_qty), 6) AS metric FROM fmain GROUP BY 1, 2),
lg AS (SELECT 'p1' AS param, metric, CAST(p1 AS DOUBLE) AS value FROM tr UNION ALL SELECT 'p2', metric, CAST(p2 AS DOUBLE) FROM tr),
ed AS (SELECT param, [quantile_cont(value, 0.2), quantile_cont(value, 0.4), quantile_cont(value, 0.6), quantile_cont(value, 0.8)] AS es FROM lg GROUP BY param),
bn AS (SELECT l.param, len(list_filter(list_distinct(es), lambda x: x < value)) AS b, count(*) AS n, avg(metric) AS m FROM lg l JOIN ed ON l.param = ed.param GROUP BY 1, 2),
sh AS (SELECT param, sum(n * (m - gm) * (m - gm)) / max(gv * gn) AS raw FROM bn, (SELECT avg(metric) AS gm, var_pop(metric) AS gv, count(*) AS gn FROM tr) GROUP BY param)""",
    body="SELECT param, round(raw / sum(raw) OVER (), 6) AS share FROM sh"))
def h08(spark: SparkSession, sf: str) -> DataFrame:
    trials = fx.main_raw(spark, sf).groupBy(
        F.round(F.col("f_disc") * 100).cast("int").alias("p1"), F.col("f_line").cast("int").alias("p2")
    ).agg(F.round(F.avg("f_qty"), 6).alias("metric"))
    return rnd(ch.parameter_importance(trials, ["p1", "p2"], "metric"), "share")
