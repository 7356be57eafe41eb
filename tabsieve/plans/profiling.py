"""Queries: aggregations, association, class profiles and leakage audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.operators import catalog as cat
from tabsieve.operators import clean as cl
from tabsieve.operators import metrics as mt
from tabsieve.operators import profile as pr
from tabsieve.plans import fixtures as fx
from tabsieve.plans.cleaning import SQL_HTML, SQL_URL, URL_CHECKED, URL_COLS
from tabsieve.plans.registry import query
from tabsieve.sources import adapters

M, N = fx.SQL_MAIN, fx.SQL_NULL
LONG = fx.long_sql("fmain")
NLONG = fx.long_sql("fnull")


def rnd(df: DataFrame, *cols: str, d: int = 6) -> DataFrame:
    """Round computed columns (and drop the sign of zero) so that both engines print the same."""
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c in cols})


@query("a01_class_balance", fx.with_sql(M, body="""
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       round(max(count(*)) OVER () / CAST(min(count(*)) OVER () AS DOUBLE), 6) AS imbalance_ratio FROM fmain GROUP BY label"""))
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.class_balance(fx.main_raw(spark, sf), "label"), "share", "imbalance_ratio")


@query("a02_sentinel_profile", fx.with_sql(M, LONG, body="""
SELECT variable, count(*) FILTER (WHERE value = -1) AS n,
  round(count(*) FILTER (WHERE value = -1) * 100.0 / count(*), 6) AS pct,
  CAST(sum(count(*) FILTER (WHERE value = -1)) OVER () AS BIGINT) AS total_cells
FROM long GROUP BY variable HAVING count(*) FILTER (WHERE value = -1) > 0"""))
def a02(spark: SparkSession, sf: str) -> DataFrame:
    s = pr.sentinel_profile(fx.main_raw(spark, sf), fx.FEATURES)
    total = s.agg(F.sum("n").alias("total_cells"))
    return rnd(s.join(F.broadcast(total)), "pct")


@query("a03_null_profile", fx.with_sql(M, N, NLONG, body="""
SELECT variable, count(*) - count(value) AS n, round((count(*) - count(value)) * 100.0 / count(*), 6) AS pct
FROM long GROUP BY variable HAVING count(*) > count(value)"""))
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.null_profile(fx.main_null(spark, sf), fx.FEATURES), "pct")


@query("a04_missingness_levels", fx.with_sql(M, N, NLONG, body="""
SELECT pct, count(*) AS n_columns, min(variable) AS example FROM (
  SELECT variable, round((count(*) - count(value)) * 100.0 / count(*), 3) AS pct FROM long GROUP BY variable
  HAVING count(*) > count(value)) GROUP BY pct"""))
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return pr.missingness_levels(pr.null_profile(fx.main_null(spark, sf), fx.FEATURES))


SQL_CONF = """g AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM fdup
  GROUP BY l_linenumber, l_discount, l_tax, l_quantity)"""


@query("a05_a06_duplicates_and_conflicts", fx.with_sql(fx.SQL_DUP, SQL_CONF, body="""
SELECT CAST(sum(n - k) AS BIGINT) AS dup_all, CAST(sum(n - 1) AS BIGINT) AS dup_features,
  count(*) FILTER (WHERE k > 1) AS conflict_groups, CAST(sum(n) FILTER (WHERE k > 1) AS BIGINT) AS conflict_rows FROM g"""))
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return cl.duplicate_report(fx.dup(spark, sf), fx.DUP_FEATURES, "label")


@query("a06_conflict_groups", fx.with_sql(fx.SQL_DUP, body="""
SELECT l_linenumber, l_discount, l_tax, l_quantity, count(*) AS n FROM fdup
GROUP BY l_linenumber, l_discount, l_tax, l_quantity HAVING min(label) <> max(label)"""))
def a06(spark: SparkSession, sf: str) -> DataFrame:
    return cl.conflict_groups(fx.dup(spark, sf), fx.DUP_FEATURES, "label")


@query("a07_distinct_counts", fx.with_sql(M, N, NLONG, body="""
SELECT variable, count(DISTINCT value) AS n_distinct FROM long GROUP BY variable"""))
def a07(spark: SparkSession, sf: str) -> DataFrame:
    return pr.distinct_counts(fx.main_null(spark, sf), fx.FEATURES)


@query("a08_dominance", fx.with_sql(M, N, NLONG, body="""
SELECT variable, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS dominance FROM (
  SELECT variable, value, count(*) AS n FROM long GROUP BY variable, value) GROUP BY variable"""))
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.dominance(fx.main_null(spark, sf), fx.FEATURES), "dominance")


@query("a09_constancy", fx.with_sql(M, LONG, body="""
SELECT variable, CASE WHEN d = 1 THEN 'constant' WHEN d >= 0.98 THEN 'quasi_constant' ELSE 'varied' END AS kind FROM (
  SELECT variable, max(n) / CAST(sum(n) AS DOUBLE) AS d FROM (
    SELECT variable, value, count(*) AS n FROM long GROUP BY variable, value) GROUP BY variable)"""))
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return pr.constancy(fx.main_raw(spark, sf), fx.FEATURES, quasi=0.98).select("variable", "kind")


@query("a10_variable_types", fx.with_sql(M, N, NLONG, body="""
SELECT variable, count(DISTINCT value) AS n_distinct, CASE WHEN bool_and(value IN (0, 1)) THEN 'binary'
  WHEN count(DISTINCT value) <= 10 THEN 'discrete' ELSE 'continuous' END AS kind FROM long WHERE value IS NOT NULL GROUP BY variable"""))
def a10(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_null(spark, sf)
    return pr.distinct_counts(m, fx.FEATURES).join(pr.variable_types(m, fx.FEATURES).select("variable", "kind"), "variable")


@query("a11_family_counts", f"""
SELECT family, count(*) AS n, (SELECT count(*) FROM pages) AS rows FROM (
SELECT CASE WHEN ends_with(v, '_url') THEN 'url' WHEN ends_with(v, '_domain') THEN 'domain'
  WHEN ends_with(v, '_directory') THEN 'directory' WHEN ends_with(v, '_file') THEN 'file'
  WHEN ends_with(v, '_params') THEN 'params' ELSE 'external' END AS family
FROM (VALUES {', '.join(f"('{c}')" for c in URL_COLS)}) t(v)) GROUP BY family""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.urls(spark, sf)
    counts = cat.family_counts(cat.column_catalog(spark, cl.feature_columns(df, "label", ["page_id"])))
    return counts.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("rows"))))


def _pairs_sql(src: str, features: list[str], expr: str = "{c}") -> str:
    out = []
    for i, a in enumerate(features):
        for j in range(i + 1, len(features)):
            x, y = expr.format(c=a), expr.format(c=features[j])
            out.append(
                f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{features[j]}' AS b, CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 "
                f"THEN round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) END AS r FROM {src}")
    return " UNION ALL ".join(out)


@query("a12_pearson_matrix", fx.with_sql(M, body=f"SELECT i, j, a, b, r + 0.0 AS r FROM ({_pairs_sql('fmain', fx.FEATURES)})"))
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.pearson_pairs(fx.main_raw(spark, sf), fx.FEATURES), "r")


@query("a12_correlated_pairs", fx.with_sql(M, body=f"SELECT a, b, r FROM ({_pairs_sql('fmain', fx.FEATURES)}) WHERE abs(r) > 0.9"))
def a12b(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.correlated_pairs(fx.main_raw(spark, sf), fx.FEATURES), "r").select("a", "b", "r")


@query("a13_pearson_with_label", fx.with_sql(M, LONG, body="""
SELECT variable, CASE WHEN stddev_pop(value) > 0 THEN round(covar_pop(value, label) / (stddev_pop(value) * stddev_pop(label)), 6) END AS r
FROM long GROUP BY variable"""))
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.pearson_with_label(fx.main_raw(spark, sf), fx.FEATURES, "label"), "r")


@query("a14_spearman_with_label", fx.with_sql(
    M, N, NLONG, """
filled AS (SELECT variable, label, coalesce(value, median(value) OVER (PARTITION BY variable)) AS value FROM long),
ranked AS (SELECT variable, label, rank() OVER (PARTITION BY variable ORDER BY value)
           + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS r FROM filled)""", body="""
SELECT variable, CASE WHEN stddev_pop(CAST(r AS DOUBLE)) > 0
  THEN round(covar_pop(CAST(r AS DOUBLE), label) / (stddev_pop(CAST(r AS DOUBLE)) * stddev_pop(label)), 6) END AS rho
FROM ranked GROUP BY variable"""))
def a14(spark: SparkSession, sf: str) -> DataFrame:
    filled = cl.fill_with_medians(fx.main_null(spark, sf), fx.FEATURES)
    return rnd(pr.spearman_with_label(filled, fx.FEATURES, "label"), "rho")


NULLABLE = ["f_age", "f_age2", "f_qty"]


@query("a15_null_cooccurrence", fx.with_sql(M, N, body=f"""
SELECT a, b, r FROM ({_pairs_sql('fnull', NULLABLE, '(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')})"""))
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.null_cooccurrence(fx.main_null(spark, sf), NULLABLE), "r").select("a", "b", "r")


SQL_BINS = """edges AS (SELECT variable, unnest([quantile_cont(value, 0.1), quantile_cont(value, 0.2), quantile_cont(value, 0.3),
  quantile_cont(value, 0.4), quantile_cont(value, 0.5), quantile_cont(value, 0.6), quantile_cont(value, 0.7),
  quantile_cont(value, 0.8), quantile_cont(value, 0.9)]) AS e FROM long GROUP BY variable),
dedges AS (SELECT variable, list(DISTINCT e) AS es FROM edges GROUP BY variable),
binned AS (SELECT l.variable, label, CASE WHEN value IS NULL THEN -1
   ELSE len(list_filter(es, lambda x: x < value)) END AS bin FROM long l JOIN dedges d ON l.variable = d.variable),
cells AS (SELECT variable, bin, label, CAST(count(*) AS DOUBLE) AS n FROM binned GROUP BY variable, bin, label),
mi AS (SELECT variable, round(greatest(sum(n / t * ln(n * t / (nb * nl))), 0), 6) AS mi FROM (
  SELECT *, sum(n) OVER (PARTITION BY variable, bin) AS nb, sum(n) OVER (PARTITION BY variable, label) AS nl,
         sum(n) OVER (PARTITION BY variable) AS t FROM cells) GROUP BY variable)"""
SQL_ANOVA = """per AS (SELECT variable, label, CAST(count(value) AS DOUBLE) AS n, avg(value) AS m, var_pop(value) AS v FROM long
  WHERE value IS NOT NULL GROUP BY variable, label),
grand AS (SELECT variable, sum(n) AS nt, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * v) AS ssw FROM per GROUP BY variable),
anova AS (SELECT p.variable, CASE WHEN max(ssw) > 0
    THEN round((sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / (max(ssw) / (max(nt) - max(k))), 6) END AS f
  FROM per p JOIN grand g ON p.variable = g.variable GROUP BY p.variable)"""


@query("a16_mutual_information", fx.with_sql(M, N, NLONG, SQL_BINS, body="SELECT variable, mi FROM mi"))
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.mutual_information(fx.main_null(spark, sf), fx.FEATURES, "label"), "mi")


@query("a17_anova_f", fx.with_sql(M, N, NLONG, SQL_ANOVA, body="SELECT variable, f FROM anova"))
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.anova_f(fx.main_null(spark, sf), fx.FEATURES, "label"), "f")


@query("a18_ranking_table", fx.with_sql(M, N, NLONG, SQL_BINS, SQL_ANOVA, body="""
SELECT a.variable, f, mi, row_number() OVER (ORDER BY mi DESC, a.variable) AS position
FROM anova a JOIN mi ON a.variable = mi.variable""".replace("row_number() OVER", "CAST(row_number() OVER").replace(
    ") AS position", ") AS INTEGER) AS position")))
def a18(spark: SparkSession, sf: str) -> DataFrame:
    both = pr.ranking_table(fx.main_null(spark, sf), fx.FEATURES, "label").drop("position")
    from tabsieve.operators.choose import profile_positions

    return profile_positions(rnd(both, "f", "mi"), "mi", "variable")


FENCED = ["f_qty", "f_price", "f_disc", "f_tax", "f_line", "f_dup", "f_age", "f_age2", "f_quasi"]
SQL_FENCE = fx.long_sql("fnull", FENCED, "olong") + """,
q AS (SELECT variable, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM olong GROUP BY variable),
flags AS (SELECT row_id, o.variable, CAST(coalesce(value < a - 0.2 * (b - a) OR value > b + 0.2 * (b - a), false) AS INTEGER) AS f
  FROM olong o JOIN q ON o.variable = q.variable)"""


@query("a19_iqr_outliers", fx.with_sql(M, N, SQL_FENCE, body="""
SELECT 'rows' AS what, round(avg(CAST(h > 0 AS INTEGER)) * 100, 6) AS pct FROM (SELECT row_id, sum(f) AS h FROM flags GROUP BY row_id)
UNION ALL SELECT 'cells', round(avg(f) * 100, 6) FROM flags
UNION ALL SELECT variable, round(avg(f) * 100, 6) FROM flags GROUP BY variable"""))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    summary, columns = pr.iqr_outliers(fx.main_null(spark, sf), FENCED, k=0.2)
    wide = summary.select(F.col("pct_rows").alias("rows"), F.col("pct_cells").alias("cells"))
    both = wide.unpivot([], ["rows", "cells"], "what", "pct").unionByName(
        columns.select(F.col("variable").alias("what"), "pct"))
    return rnd(both, "pct")


HTML = adapters.HTML_FEATURES
HLONG = fx.long_sql("fhtml", HTML, "hlong", keep="label")


@query("a20_medians_by_class", fx.with_sql(SQL_HTML, HLONG, body="""
SELECT variable, median(value) FILTER (WHERE label = 0) AS median_0, median(value) FILTER (WHERE label = 1) AS median_1
FROM hlong GROUP BY variable"""))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return pr.medians_by_class(fx.html(spark, sf), HTML, "label", [0, 1])


@query("a21_class_profile", fx.with_sql(M, N, NLONG, body="""
SELECT variable, median(value) AS median FROM long WHERE label = 0 GROUP BY variable"""))
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return pr.class_profile(fx.main_null(spark, sf), fx.FEATURES, "label", 0)


@query("a22_crosstab", """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_F, count(*) FILTER (WHERE l_linestatus = 'O') AS n_O,
       count(*) FILTER (WHERE l_linestatus = 'X') AS n_X FROM lineitem GROUP BY l_returnflag""")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    return pr.crosstab(fx.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O", "X"])


@query("a23_binned_crosstab", fx.with_sql(SQL_HTML, body="""
SELECT bin, round(count(*) FILTER (WHERE label = 0) * 100.0 / sum(count(*) FILTER (WHERE label = 0)) OVER (), 6) AS pct_0,
  round(count(*) FILTER (WHERE label = 1) * 100.0 / sum(count(*) FILTER (WHERE label = 1)) OVER (), 6) AS pct_1 FROM (
  SELECT label, CASE WHEN LargestLineLength <= 1000 THEN '0-1k' WHEN LargestLineLength <= 5000 THEN '1k-5k'
    WHEN LargestLineLength <= 10000 THEN '5k-10k' ELSE '>10k' END AS bin FROM fhtml) GROUP BY bin"""))
def a23(spark: SparkSession, sf: str) -> DataFrame:
    tab = pr.binned_crosstab(fx.html(spark, sf), "LargestLineLength", "label", [0, 1],
                             [0, 1000, 5000, 10000, float("inf")], ["0-1k", "1k-5k", "5k-10k", ">10k"])
    return rnd(tab, "pct_0", "pct_1")


@query("a24_zero_share_by_class", fx.with_sql(SQL_HTML, HLONG, body="""
SELECT variable, label, count(*) FILTER (WHERE value = 0) AS n, round(count(*) FILTER (WHERE value = 0) * 100.0 / count(*), 6) AS pct
FROM hlong GROUP BY variable, label"""))
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.zero_share(fx.html(spark, sf), HTML, "label"), "pct")


KEY = ["f_qty", "f_price", "f_disc", "f_age"]


@query("a25_means_by_confusion_cell", fx.with_sql(M, fx.SQL_PRED, body=" UNION ALL ".join(f"""
SELECT '{c}' AS variable, round(avg({c}) FILTER (WHERE label = 1 AND pred = 0), 6) AS mean_FN,
  round(avg({c}) FILTER (WHERE label = 0 AND pred = 1), 6) AS mean_FP,
  round(avg({c}) FILTER (WHERE label = 0 AND pred = 0), 6) AS mean_TN,
  round(avg({c}) FILTER (WHERE label = 1 AND pred = 1), 6) AS mean_TP FROM fpred""" for c in KEY)))
def a25(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.predictions(spark, sf).withColumn("cell", mt.confusion_cell())
    return rnd(pr.confusion_cell_means(cells, KEY), "mean_FN", "mean_FP", "mean_TN", "mean_TP")


SQL_SCORES = """scores AS (SELECT CASE WHEN f_line <= 3 THEN 'm1' WHEN f_line <= 5 THEN 'm2' ELSE 'm3' END AS model,
  CAST(f_disc * 100 AS INTEGER) AS fold, round(avg(f_qty) / 50, 6) AS value FROM fmain GROUP BY 1, 2)"""


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score table (model, fold, value) aggregated from the main table."""
    m = fx.main_raw(spark, sf)
    model = F.when(F.col("f_line") <= 3, "m1").when(F.col("f_line") <= 5, "m2").otherwise("m3")
    return m.groupBy(model.alias("model"), F.round(F.col("f_disc") * 100).cast("int").alias("fold")).agg(
        F.round(F.avg("f_qty") / 50, 6).alias("value"))


@query("a26_fold_summary", fx.with_sql(M, SQL_SCORES, body="""
SELECT model, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM scores GROUP BY model"""))
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.fold_summary(fold_scores(spark, sf), ["model"]), "mean", "std")


@query("a27_seed_summary", fx.with_sql(M, SQL_SCORES, body="""
SELECT model, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(max(value) - min(value), 6) AS range
FROM scores GROUP BY model"""))
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.seed_summary(fold_scores(spark, sf), ["model"]), "mean", "std", "range")




@query("a28_profile_summary", fx.with_sql(M, N, LONG, fx.long_sql("fnull", name="nlong"), """
h AS (SELECT variable, value, count(*) AS n FROM long GROUP BY variable, value),
dom AS (SELECT variable, max(n) / CAST(sum(n) AS DOUBLE) AS d, bool_and(value IN (0, 1)) AS is01 FROM h GROUP BY variable),
grp AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM fmain GROUP BY """ + ", ".join(fx.FEATURES) + ")",
    body=f"""
SELECT (SELECT CAST(sum(n - k) AS BIGINT) FROM grp) AS dup_all, (SELECT CAST(sum(n - 1) AS BIGINT) FROM grp) AS dup_features,
  (SELECT count(*) FROM grp WHERE k > 1) AS conflict_groups,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM grp WHERE k > 1) AS conflict_rows,
  (SELECT count(DISTINCT variable) FROM long WHERE value = -1) AS sentinel_columns,
  (SELECT count(*) FROM long WHERE value = -1) AS sentinel_cells,
  (SELECT count(*) FROM dom WHERE d = 1) AS constant, (SELECT count(*) FROM dom WHERE d >= 0.99 AND d < 1) AS quasi_constant,
  (SELECT count(*) FROM dom WHERE is01) AS binary,
  (SELECT count(*) FROM ({_pairs_sql('fmain', fx.FEATURES)}) WHERE abs(r) > 0.9) AS correlated_pairs,
  (SELECT count(*) FROM ({_pairs_sql('fnull', NULLABLE, '(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')})
   WHERE abs(r) > 0.95) AS comissing_pairs"""))
def a28(spark: SparkSession, sf: str) -> DataFrame:
    return pr.profile_summary(fx.main_raw(spark, sf), fx.FEATURES, "label")


@query("a30_majority_baseline", fx.with_sql(M, body="""
SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS majority_accuracy FROM (SELECT count(*) AS n FROM fmain GROUP BY label)"""))
def a30(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.majority_baseline(fx.main_raw(spark, sf), "label"), "majority_accuracy")


_CUT_LIST = ", ".join(f"quantile_cont(value, {p!r}::DOUBLE)" for p in pr.CUT_PROBS)
SQL_CUTS = f"""cuts AS (SELECT variable, list_distinct([{_CUT_LIST}]) AS cs FROM long GROUP BY variable
  HAVING count(DISTINCT value) > 1),
counts AS (SELECT variable, value, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM long GROUP BY variable, value),
ex AS (SELECT variable, unnest(cs) AS cut FROM cuts),
acc AS (SELECT c.variable, cut,
    sum(CASE WHEN value >= cut THEN pos ELSE 0 END + CASE WHEN coalesce(value >= cut, false) THEN 0 ELSE neg END) AS ge,
    sum(CASE WHEN value < cut THEN pos ELSE 0 END + CASE WHEN coalesce(value < cut, false) THEN 0 ELSE neg END) AS lt,
    sum(pos + neg) AS n FROM counts c JOIN ex ON c.variable = ex.variable GROUP BY c.variable, cut),
best AS (SELECT variable, round(max(greatest(ge, lt) / CAST(n AS DOUBLE)), 6) AS accuracy FROM acc GROUP BY variable)"""


@query("a31_best_single_cut", fx.with_sql(M, N, NLONG, SQL_CUTS, body="SELECT variable, accuracy FROM best"))
def a31(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.best_cut_per_variable(fx.main_null(spark, sf), fx.FEATURES, "label"), "accuracy")


SQL_DEG = fx.long_sql("furl3", URL_CHECKED, "ulong", keep="label") + """,
st AS (SELECT variable, label, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ulong GROUP BY variable, label),
con AS (SELECT variable, label AS constant_class, lo AS value FROM st WHERE lo = hi),
dif AS (SELECT c.variable, constant_class, c.value, CAST(sum(CAST(u.value <> c.value AS INTEGER)) AS BIGINT) AS n_differs,
  round(avg(CAST(u.value <> c.value AS INTEGER)) * 100, 6) AS pct_differs
  FROM con c JOIN ulong u ON u.variable = c.variable AND u.label <> constant_class GROUP BY 1, 2, 3)"""


@query("a32_degenerate_features", fx.with_sql(M, """gl AS (SELECT CASE WHEN label = 1 THEN 0.0::DOUBLE ELSE f_qty END AS g_leak,
  f_qty AS g_free, label FROM fmain)""", body="""
SELECT 'g_leak' AS variable, 1 AS constant_class, 0.0::DOUBLE AS value, count(*) FILTER (WHERE g_leak <> 0) AS n_differs,
  round(count(*) FILTER (WHERE g_leak <> 0) * 100.0 / count(*), 6) AS pct_differs FROM gl WHERE label = 0"""))
def a32(spark: SparkSession, sf: str) -> DataFrame:
    leak = F.when(F.col("label") == 1, 0.0).otherwise(F.col("f_qty"))
    df = fx.main_raw(spark, sf).select("label", leak.alias("g_leak"), F.col("f_qty").alias("g_free"))
    return rnd(pr.degenerate_features(df, ["g_leak", "g_free"], "label"), "pct_differs")


@query("a33_constant_in_class", fx.with_sql(SQL_URL, SQL_DEG, body="""
SELECT variable, constant_class, value, n_differs, pct_differs FROM dif"""))
def a33(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.constant_in_class(fx.urls(spark, sf), URL_CHECKED, "label"), "pct_differs")


@query("a34_leak_rule_accuracy", fx.with_sql(SQL_URL, body="""
SELECT round(avg(CAST((params_length = -1) = (label = 1) AS INTEGER)), 6) AS accuracy, count(*) AS rows FROM furl3"""))
def a34(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.rule_accuracy(fx.urls(spark, sf), F.col("params_length") == -1, "label"), "accuracy")


@query("a35_presence_by_class", fx.with_sql(SQL_URL, fx.long_sql("furl3", ["qty_questionmark_url", "qty_equal_url", "qty_and_url"], "q3", keep="label"), body="""
SELECT variable, label, count(*) FILTER (WHERE value > 0) AS n, round(count(*) FILTER (WHERE value > 0) * 100.0 / count(*), 6) AS pct
FROM q3 GROUP BY variable, label"""))
def a35(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(pr.presence_share(fx.urls(spark, sf), ["qty_questionmark_url", "qty_equal_url", "qty_and_url"], "label"), "pct")


@query("a37_winner_counts", fx.with_sql(M, """sc AS (SELECT CASE WHEN f_line <= 3 THEN 'm1' WHEN f_line <= 5 THEN 'm2' ELSE 'm3' END AS model,
  'q' AS comparison, CAST(f_disc * 100 AS INTEGER) AS seed, round(round(avg(f_qty) / 50, 6), 2) AS m FROM fmain GROUP BY 1, 3),
mk AS (SELECT *, max(m) OVER (PARTITION BY comparison, seed) AS b FROM sc),
td AS (SELECT *, count(*) OVER (PARTITION BY comparison, seed) AS nb FROM mk WHERE m = b)""", body="""
SELECT comparison, model, count(*) FILTER (WHERE nb = 1) AS wins, count(*) FILTER (WHERE nb > 1) AS ties FROM td GROUP BY 1, 2"""))
def a37(spark: SparkSession, sf: str) -> DataFrame:
    s = fold_scores(spark, sf).withColumnsRenamed({"fold": "seed"}).withColumn("comparison", F.lit("q"))
    return pr.winner_counts(s, "comparison", "seed", "model", "value", decimals=2)


@query("a38_balance_before_after", fx.with_sql(fx.SQL_DUP, """cl AS (SELECT min(label) AS label FROM fdup
  GROUP BY l_linenumber, l_discount, l_tax, l_quantity HAVING min(label) = max(label)),
a AS (SELECT label, count(*) AS n_before FROM fdup GROUP BY label), b AS (SELECT label, count(*) AS n_after FROM cl GROUP BY label)""", body="""
SELECT a.label, n_before, coalesce(n_after, 0) AS n_after, round(n_before / CAST(sum(n_before) OVER () AS DOUBLE), 6) AS share_before,
  round(coalesce(n_after, 0) / CAST(sum(n_after) OVER () AS DOUBLE), 6) AS share_after FROM a LEFT JOIN b ON a.label = b.label"""))
def a38(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.dup(spark, sf)
    out = pr.balance_before_after(d, cl.clean(d, fx.DUP_FEATURES, "label"), "label")
    return rnd(out, "share_before", "share_after")
