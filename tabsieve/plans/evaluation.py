"""Queries: metrics, curves, thresholds, calibration, cost, paired tests and manipulation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.operators import metrics as mt
from tabsieve.operators import robust as rb
from tabsieve.operators import stats as st
from tabsieve.operators.catalog import controllable
from tabsieve.operators.profile import class_profile
from tabsieve.plans import fixtures as fx
from tabsieve.plans.cleaning import SQL_URL, URL_CHECKED
from tabsieve.plans.profiling import SQL_SCORES, fold_scores, rnd
from tabsieve.plans.registry import query

M, P = fx.SQL_MAIN, fx.SQL_PRED
CELLS = """SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp"""
SQL_FUN = """round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy,
  round((coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) + coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0)) / 2, 6) AS balanced_accuracy,
  round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
  round(coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0), 6) AS specificity,
  round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1,
  round(coalesce((tp * CAST(tn AS DOUBLE) - fp * CAST(fn AS DOUBLE)) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE))
    * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0), 6) + 0.0::DOUBLE AS mcc"""
RATES = ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "mcc"]
SQL_CURVE = """h AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM fpred GROUP BY score),
curve AS (SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS q FROM h)"""
SQL_AREA = """area AS (SELECT round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(p * q), 6) AS roc_auc,
  round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM curve)"""
LOSS = """round(avg((score - label) * (score - label)), 6) AS brier,
  round(-avg(CASE WHEN label = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END), 6) AS log_loss"""


@query("c01_confusion_matrix", fx.with_sql(M, P, body="""
SELECT label, pred, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE), 6) AS row_share
FROM fpred GROUP BY label, pred"""))
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.confusion_rates(fx.predictions(spark, sf)), "row_share")


@query("c02_c03_rates_and_mcc", fx.with_sql(M, P, f"cm AS ({CELLS} FROM fpred)", body=f"SELECT tn, fp, fn, tp, {SQL_FUN} FROM cm"))
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.rates_from_counts(mt.confusion(fx.predictions(spark, sf))), *RATES)


@query("c02_metrics_by_group", fx.with_sql(M, P, f"cm AS ({CELLS}, f_line FROM fpred GROUP BY f_line)", body=f"SELECT f_line, tn, fp, fn, tp, {SQL_FUN} FROM cm"))
def c02b(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.rates_from_counts(mt.confusion(fx.predictions(spark, sf), by=["f_line"])), *RATES)


@query("c04_roc_auc", fx.with_sql(M, P, SQL_CURVE, SQL_AREA, body="SELECT roc_auc FROM area"))
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.roc_auc(fx.predictions(spark, sf)), "roc_auc")


@query("c04_roc_auc_by_group", fx.with_sql(M, P, """r AS (SELECT f_line, label,
  rank() OVER (PARTITION BY f_line ORDER BY f_price) + (count(*) OVER (PARTITION BY f_line, f_price) - 1) / 2.0 AS r FROM fpred)""", body="""
SELECT f_line, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE)), 6) AS roc_auc FROM r GROUP BY f_line"""))
def c04b(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.roc_auc(fx.main_raw(spark, sf), score="f_price", by=["f_line"]), "roc_auc")


@query("c05_average_precision", fx.with_sql(M, P, SQL_CURVE, SQL_AREA, body="SELECT average_precision FROM area"))
def c05(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.average_precision(fx.predictions(spark, sf)), "average_precision")


@query("c06_brier_and_log_loss", fx.with_sql(M, P, body=f"SELECT {LOSS} FROM fpred"))
def c06(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.probability_losses(fx.predictions(spark, sf)), "brier", "log_loss")


@query("c02_c06_full_report", fx.with_sql(M, P, SQL_CURVE, SQL_AREA, f"cm AS ({CELLS}, {LOSS} FROM fpred)", body=f"""
SELECT tn, fp, fn, tp, {SQL_FUN}, brier, log_loss, roc_auc, average_precision FROM cm, area"""))
def c_full(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.binary_metrics(fx.predictions(spark, sf)), *RATES, "brier", "log_loss", "roc_auc", "average_precision")


@query("c07_bootstrap_intervals")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    return mt.bootstrap_intervals(mt.bootstrap_metrics(fx.predictions(spark, sf), replicates=1000))


SQL_PR = """pr AS (SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall,
  round(2 * tp / (tp + fp + p), 6) AS f1 FROM curve)"""


@query("c08_pr_curve", fx.with_sql(M, P, SQL_CURVE, SQL_PR, body="SELECT * FROM pr"))
def c08(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.pr_curve(fx.predictions(spark, sf)), "precision", "recall", "f1")


@query("c08_best_f1_threshold", fx.with_sql(M, P, SQL_CURVE, body="""
SELECT score AS threshold, round(2 * tp / (tp + fp + p), 6) AS f1 FROM curve ORDER BY 2 * tp / (tp + fp + p) DESC, score LIMIT 1"""))
def c08b(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.best_f1_threshold(fx.predictions(spark, sf)), "f1")


@query("c09_threshold_for_recall", fx.with_sql(M, P, SQL_CURVE, body="SELECT max(score) AS threshold FROM curve WHERE tp / p >= 0.97"))
def c09(spark: SparkSession, sf: str) -> DataFrame:
    return mt.threshold_for_recall(fx.predictions(spark, sf))


def _at(grid: str) -> str:
    return f"""grid AS (SELECT threshold, count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn,
  count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn,
  count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp FROM fpred, ({grid}) GROUP BY threshold)"""


@query("c10_operating_points", fx.with_sql(M, P, _at("SELECT unnest([0.25, 0.5, 0.755]::DOUBLE[]) AS threshold"), body=f"SELECT threshold, tn, fp, fn, tp, {SQL_FUN} FROM grid"))
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.metrics_at(fx.predictions(spark, sf), [0.25, 0.5, 0.755]), *RATES)


@query("c11_roc_curve", fx.with_sql(M, P, SQL_CURVE, body="SELECT score AS threshold, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr FROM curve"))
def c11(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.roc_curve(fx.predictions(spark, sf)), "fpr", "tpr")


_Q = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10))


@query("c12_reliability_diagram", fx.with_sql(M, P, f"ed AS (SELECT [{_Q}] AS es FROM fpred)", body="""
SELECT CAST(len(list_filter(es, lambda x: x < score)) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score,
  round(avg(label), 6) AS observed FROM fpred, ed GROUP BY 1"""))
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.reliability(fx.predictions(spark, sf)), "mean_score", "observed")


GRID91 = "SELECT round(CAST(0.05 AS DOUBLE) + CAST(0.9 AS DOUBLE) * i / 90, 12) AS threshold FROM range(91) t(i)"
SQL_COST = "cost AS (SELECT threshold, ratio, (fn * ratio + fp) / CAST(tn + fp + fn + tp AS DOUBLE) AS cost FROM grid, (SELECT unnest([1, 3, 5, 10]::INTEGER[]) AS ratio))"


@query("c13_expected_cost", fx.with_sql(M, P, _at(GRID91), SQL_COST, body="SELECT threshold, ratio, round(cost, 6) AS cost FROM cost"))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.expected_cost(fx.predictions(spark, sf)), "cost")


@query("c13_cheapest_threshold", fx.with_sql(M, P, _at(GRID91), SQL_COST, body="""
SELECT ratio, threshold, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY cost, threshold) AS rn FROM cost) WHERE rn = 1"""))
def c13b(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.cheapest_threshold(mt.expected_cost(fx.predictions(spark, sf))), "cost")


@query("c14_best_threshold_on_grid", fx.with_sql(M, P, _at("SELECT round(CAST(0.01 AS DOUBLE) + CAST(0.98 AS DOUBLE) * i / 196, 12) AS threshold FROM range(197) t(i)"), body="""
SELECT threshold, round(f1, 6) AS f1 FROM (SELECT threshold, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM grid) ORDER BY f1 DESC, threshold LIMIT 1"""))
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(mt.best_threshold(fx.predictions(spark, sf)), "f1")


@query("c15_base_rate_projection", fx.with_sql(M, P, f"cm AS ({CELLS} FROM fpred)", """
rt AS (SELECT tp / CAST(tp + fn AS DOUBLE) AS r, tn / CAST(tn + fp AS DOUBLE) AS s, unnest([0.3497, 0.1, 0.01, 0.001]::DOUBLE[]) AS prevalence FROM cm)""", body="""
SELECT prevalence, round(prevalence * 1e6 * r, 3) AS tp, round(prevalence * 1e6 * (1 - r), 3) AS fn, round((1 - prevalence) * 1e6 * (1 - s), 3) AS fp,
  round(prevalence * r / (prevalence * r + (1 - prevalence) * (1 - s)), 6) AS precision FROM rt"""))
def c15(spark: SparkSession, sf: str) -> DataFrame:
    out = mt.base_rate_projection(fx.predictions(spark, sf))
    return rnd(rnd(out, "tp", "fn", "fp", d=3), "precision")


@query("w03_cumulative_counts", fx.with_sql(M, P, SQL_CURVE, body="SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM curve"))
def w03(spark: SparkSession, sf: str) -> DataFrame:
    return mt.score_curve(mt.score_histogram(fx.predictions(spark, sf))).select("score", "tp", "fp")


# ---- paired tests ----------------------------------------------------------------------------

SQL_LONG = SQL_SCORES + ", sc AS (SELECT 'q' AS comparison, model, fold AS block, value AS score FROM scores)"


def paired(spark: SparkSession, sf: str) -> DataFrame:
    return fold_scores(spark, sf).select(F.lit("q").alias("comparison"), "model", F.col("fold").alias("block"),
                                         F.col("value").alias("score"))


@query("v01_friedman", fx.with_sql(M, SQL_LONG, """
rk AS (SELECT *, rank() OVER (PARTITION BY comparison, block ORDER BY score) + (count(*) OVER (PARTITION BY comparison, block, score) - 1) / 2.0 AS r FROM sc),
ti AS (SELECT comparison, sum(t * t * t - t) AS ties FROM (SELECT comparison, block, score, count(*) AS t FROM sc GROUP BY 1, 2, 3) GROUP BY 1),
su AS (SELECT comparison, model, CAST(sum(r) AS DOUBLE) AS rs, count(*) AS b FROM rk GROUP BY 1, 2),
ag AS (SELECT comparison, count(*) AS k, max(b) AS n, sum(rs * rs) AS ssr FROM su GROUP BY 1)""", body="""
SELECT a.comparison, CAST(k AS INTEGER) AS models, CAST(n AS INTEGER) AS blocks, round((12.0::DOUBLE / (n * k * (k + 1)) * ssr - 3.0 * n * (k + 1))
  / (1 - CAST(ties AS DOUBLE) / (n * (k * k * k - k))), 6) AS chi2 FROM ag a JOIN ti ON a.comparison = ti.comparison"""))
def v01(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(st.friedman(paired(spark, sf)), "chi2").drop("p")


SQL_WILC = """mn AS (SELECT comparison, model, avg(score) AS m FROM sc GROUP BY 1, 2),
ld AS (SELECT comparison, model AS leader FROM (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY m DESC, model) AS rn FROM mn) WHERE rn = 1),
df AS (SELECT a.comparison, leader, a.model, b.score - a.score AS d FROM sc a JOIN ld ON a.comparison = ld.comparison
  JOIN sc b ON b.comparison = a.comparison AND b.model = leader AND b.block = a.block WHERE a.model <> leader),
rk AS (SELECT *, rank() OVER (PARTITION BY comparison, model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparison, model, abs(d)) - 1) / 2.0 AS r
  FROM df WHERE d <> 0),
wx AS (SELECT comparison, leader, model, count(*) AS n, CAST(least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS DOUBLE) AS w
  FROM rk GROUP BY 1, 2, 3)"""


@query("v02_signed_rank", fx.with_sql(M, SQL_LONG, SQL_WILC, body="""
SELECT w.comparison, w.leader, w.model, n, w, round((SELECT avg(d) FROM df WHERE df.model = w.model), 6) AS diff FROM wx w"""))
def v02(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(st.signed_rank(paired(spark, sf)), "diff").drop("p")


@query("v03_leader_vs_all_holm")
def v03(spark: SparkSession, sf: str) -> DataFrame:
    return st.leader_vs_all(paired(spark, sf))


SQL_PS = """ps AS (SELECT comparison, model, p FROM (SELECT CAST(f_line AS VARCHAR) AS model, 'q' AS comparison, round(avg(f_disc), 4) * 0.3 AS p
  FROM fmain GROUP BY f_line))"""


@query("w05_holm_step_down", fx.with_sql(M, SQL_PS, """
st AS (SELECT *, least(1, p * (count(*) OVER (PARTITION BY comparison) - row_number() OVER (PARTITION BY comparison ORDER BY p, model) + 1)) AS raw FROM ps)""", body="""
SELECT comparison, model, round(p, 6) AS p, round(max(raw) OVER (PARTITION BY comparison ORDER BY p, model ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM st"""))
def w05(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.main_raw(spark, sf).groupBy(F.col("f_line").cast("string").alias("model")).agg(
        (F.round(F.avg("f_disc"), 4) * 0.3).alias("p")).withColumn("comparison", F.lit("q"))
    return rnd(st.holm(p), "p", "p_holm")


@query("w05_holm_unadjusted", fx.with_sql(M, SQL_PS, body="""
SELECT comparison, model, round(p, 6) AS p, round(least(1, p * (count(*) OVER (PARTITION BY comparison)
  - row_number() OVER (PARTITION BY comparison ORDER BY p, model) + 1)), 6) AS p_holm FROM ps"""))
def w05b(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.main_raw(spark, sf).groupBy(F.col("f_line").cast("string").alias("model")).agg(
        (F.round(F.avg("f_disc"), 4) * 0.3).alias("p")).withColumn("comparison", F.lit("q"))
    return rnd(st.holm(p, monotone=False), "p", "p_holm")


@query("t06_change_rule", fx.with_sql(M, SQL_PS, body="SELECT comparison, model, p < 0.0151 AND p * 10 >= 0.149 AS switch FROM ps"))
def t06(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.main_raw(spark, sf).groupBy(F.col("f_line").cast("string").alias("model")).agg(
        (F.round(F.avg("f_disc"), 4) * 0.3).alias("p")).withColumns({"comparison": F.lit("q"), "diff": F.col("p") * 10})
    return st.should_switch(p, alpha=0.0151, margin=0.149).select("comparison", "model", "switch")


# ---- manipulation tables ---------------------------------------------------------------------

LENGTHS = ["length_url", "directory_length", "file_length", "params_length", "qty_slash_url", "domain_length"]


def url_profile(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {r["variable"]: r["median"] for r in class_profile(df, columns, "label", 0).collect()}


SQL_PERT = "prof AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in LENGTHS) + " FROM furl3 WHERE label = 0), " + (
    "pert AS (SELECT page_id, effort, length_url >= directory_length + file_length + params_length AS before, "
    + ", ".join(f"(1 - effort) * {c} + effort * m_{c} AS {c}" for c in LENGTHS)
    + " FROM furl3, prof, (SELECT unnest([0, 0.25, 0.5, 0.75, 1]::DOUBLE[]) AS effort) WHERE label = 1)")


@query("b01_j07_j08_imitation_table", fx.with_sql(SQL_URL, SQL_PERT, body="SELECT page_id, effort, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in LENGTHS) + " FROM pert"))
def b01(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.urls(spark, sf).select("page_id", "label", *URL_CHECKED)
    columns = controllable(LENGTHS)
    moved = rb.imitate(rb.with_efforts(df.filter("label = 1")), url_profile(df, columns), columns)
    return rnd(moved.select("page_id", "effort", *LENGTHS), *LENGTHS)


@query("b03_random_direction_control")
def b03(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.urls(spark, sf).select("page_id", "label", *LENGTHS)
    moved = rb.jitter(rb.with_efforts(df.filter("label = 1")), url_profile(df, LENGTHS), LENGTHS, key="page_id")
    return moved.groupBy("effort").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in LENGTHS])


@query("b04_consistency_broken", fx.with_sql(SQL_URL, SQL_PERT, body="""
SELECT effort, count(*) AS rows, count(*) FILTER (WHERE before) AS consistent_before,
  count(*) FILTER (WHERE before AND NOT (length_url >= directory_length + file_length + params_length)) AS broken,
  round(coalesce(count(*) FILTER (WHERE before AND NOT (length_url >= directory_length + file_length + params_length)) * 100.0
    / nullif(count(*) FILTER (WHERE before), 0), 0), 6) AS pct FROM pert GROUP BY effort"""))
def b04(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.urls(spark, sf).select("page_id", "label", *URL_CHECKED)
    columns = controllable(LENGTHS)
    return rnd(rb.broken_by_attack(df.filter("label = 1"), url_profile(df, columns), columns), "pct")
