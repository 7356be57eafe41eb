"""Queries: scans, sinks, projections, joins, duplicates, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.functions import scalar as fn
from tabsieve.operators import catalog as cat
from tabsieve.operators import clean as cl
from tabsieve.operators import profile as pr
from tabsieve.plans import fixtures as fx
from tabsieve.plans.registry import query
from tabsieve.sources import adapters, files, sinks

M = fx.SQL_MAIN
LINE_SCHEMA = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
               "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
               "l_linestatus string, l_shipdate timestamp")


# ---- sources and sinks -----------------------------------------------------------------------

@query("s01_csv_scan", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price,
       CAST(max(l_linenumber) AS INTEGER) AS max_line
FROM lineitem GROUP BY l_returnflag""")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "lineitem-csv")
    sinks.result_table(fx.table(spark, sf, "lineitem"), path)
    return files.read_csv(spark, path, LINE_SCHEMA).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.max("l_linenumber").alias("max_line"))


@query("s03_file_integrity")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    known = files.file_hashes(spark, f"{sf}/lineitem.parquet").select("file", "sha256").collect()
    manifest = {r["file"]: r["sha256"] for r in known}  # one entry per data file
    manifest["missing.parquet"] = "0" * 64
    return files.verify_files(spark, f"{sf}/lineitem.parquet", manifest, on_mismatch="warn")


LINE_SET = files.Dataset(
    name="lines", path="", target="l_returnflag", positive="R",
    drop=("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate"), suspicious="l_tax",
    common={"size": "l_quantity", "rebate": "l_discount"})


@query("s04_dataset_registry", """
WITH d AS (SELECT l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag = 'R' AS label FROM lineitem)
SELECT 'lines' AS dataset, 'full' AS view, count(*) AS rows, 'l_tax' AS suspicious FROM (SELECT DISTINCT * FROM d)
UNION ALL SELECT 'lines', 'common', count(*), 'l_tax' FROM (SELECT DISTINCT l_quantity, l_discount, label FROM d)""")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.table(spark, sf, "lineitem")
    loaded = files.normalise(t, LINE_SET)
    aligned = files.normalise(t, LINE_SET, only_common=True)
    sizes = loaded.agg(F.count(F.lit(1)).alias("rows")).withColumn("view", F.lit("full")).unionByName(
        aligned.agg(F.count(F.lit(1)).alias("rows")).withColumn("view", F.lit("common")))
    return sizes.select(F.lit(LINE_SET.name).alias("dataset"), "view", "rows",
                        F.lit(LINE_SET.suspicious).alias("suspicious"))


@query("s05_load_normalise", fx.with_sql(
    """d AS (SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_tax, CAST(l_returnflag = 'R' AS INTEGER) AS label,
             l_extendedprice FROM lineitem)""",
    body="""SELECT count(*) AS rows, CAST(sum(CAST(l_linenumber IS NULL AS BIGINT) + CAST(l_quantity IS NULL AS BIGINT)
    + CAST(l_discount IS NULL AS BIGINT) + CAST(l_tax IS NULL AS BIGINT) + CAST(l_extendedprice IS NULL AS BIGINT)) AS BIGINT) AS null_cells,
  count(*) FILTER (WHERE label = 1) AS positives,
  count(*) FILTER (WHERE label = 0) AS negatives,
  round(greatest(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0))
        / CAST(least(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) AS DOUBLE), 6) AS imbalance_ratio,
  (SELECT count(*) FROM lineitem) - count(*) AS duplicates FROM d"""))
def s05(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.table(spark, sf, "lineitem")
    d = files.normalise(t, LINE_SET)
    stats = cl.load_stats(d, cl.feature_columns(d, "label"), "label")
    raw = t.agg(F.count(F.lit(1)).alias("raw"))
    return stats.join(F.broadcast(raw)).select(
        "rows", "null_cells", "positives", "negatives", F.round("imbalance_ratio", 6).alias("imbalance_ratio"),
        (F.col("raw") - F.col("rows")).alias("duplicates"))


def _grouped(t: DataFrame) -> DataFrame:
    return t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("s06_checkpointed_stage", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    root = sinks.scratch_path(spark, "stages")
    t = fx.table(spark, sf, "lineitem")
    sinks.checkpointed(spark, root, "counts", lambda: _grouped(t))

    def never() -> DataFrame:
        raise AssertionError("a finished stage must be read, not recomputed")

    return sinks.checkpointed(spark, root, "counts", never)


@query("s07_split_checkpoint", fx.with_sql(M, fx.SQL_NULL, fx.SQL_SPLIT, body="""
SELECT split, label, count(*) AS n FROM fsplit GROUP BY split, label"""))
def s07(spark: SparkSession, sf: str) -> DataFrame:
    root = sinks.scratch_path(spark, "split")
    train, test = sinks.checkpointed_split(spark, root, "v03", lambda: fx.split_main(spark, sf))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s08_json_decision")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    root = sinks.scratch_path(spark, "decisions")
    top = _grouped(fx.table(spark, sf, "lineitem")).orderBy(F.desc("n"), "l_returnflag").limit(1)
    got = sinks.decision(spark, root, "flag", lambda: top.first().asDict())
    return spark.createDataFrame([(got["l_returnflag"], got["n"])], "l_returnflag string, n bigint")


@query("s09_result_table_csv", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "table")
    sinks.result_table(_grouped(fx.table(spark, sf, "lineitem")), path)
    return files.read_csv(spark, path, "l_returnflag string, n bigint")


@query("s10_experiment_log", fx.with_sql(M, body="""
SELECT CAST(label AS VARCHAR) AS modelo, 'balance' AS bloque, round(count(*) / sum(count(*)) OVER (), 5) AS share
FROM fmain GROUP BY label"""))
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "log")
    b = pr.class_balance(fx.main_raw(spark, sf), "label")
    results = b.select(F.col("label").cast("string").alias("modelo"), "share", "imbalance_ratio")
    sinks.log_metrics_frame(results, path, "balance", keys=("modelo",))
    log = spark.read.parquet(path)
    metrics = F.from_json("metricas", "share double, imbalance_ratio double")
    return log.select("modelo", "bloque", metrics["share"].alias("share"))


@query("s11_lineage_register", """
SELECT 'v01' AS version, 'raw' AS origen, count(*) AS filas, CAST(5 AS INTEGER) AS columnas FROM (
  SELECT l_linenumber, l_discount, l_tax, l_quantity, l_returnflag = 'R' FROM lineitem)
UNION ALL
SELECT 'v02', 'v01', count(*), 5 FROM (
  SELECT l_linenumber, l_discount, l_tax, l_quantity FROM lineitem GROUP BY ALL
  HAVING min(CAST(l_returnflag = 'R' AS INTEGER)) = max(CAST(l_returnflag = 'R' AS INTEGER)))""")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    root = sinks.scratch_path(spark, "versions")
    v1 = sinks.write_version(spark, fx.dup(spark, sf), root, "v01", "raw", "as read", "start")
    sinks.write_version(spark, cl.clean(v1, fx.DUP_FEATURES, "label"), root, "v02", "v01",
                        "copies and contradictions removed", "one label per feature vector")
    return sinks.read_lineage(spark, root).select("version", "origen", "filas", "columnas")


@query("s14_recompute_and_verify", fx.with_sql(fx.SQL_DUP, body="""
SELECT CAST(sum(n) AS BIGINT) AS rows_in, CAST(coalesce(sum(n) FILTER (WHERE lo <> hi), 0) AS BIGINT) AS rows_conflict,
       CAST(coalesce(sum(n - 1) FILTER (WHERE lo = hi), 0) AS BIGINT) AS rows_duplicate,
       count(*) FILTER (WHERE lo = hi) AS rows_out
FROM (SELECT count(*) AS n, min(label) AS lo, max(label) AS hi FROM fdup GROUP BY ALL) t""".replace(
    "FROM fdup GROUP BY ALL", "FROM fdup GROUP BY l_linenumber, l_discount, l_tax, l_quantity")))
def s14(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.dup(spark, sf)
    # The saved counts come from other plans than the ones they verify: join back, then distinct.
    agreed = cl.drop_contradictions(df, fx.DUP_FEATURES, "label")
    rows_in, rows_agreed, rows_out = df.count(), agreed.count(), agreed.distinct().count()
    saved = sinks.decision(spark, sinks.scratch_path(spark, "saved"), "counts", lambda: {
        "rows_in": rows_in, "rows_conflict": rows_in - rows_agreed, "rows_duplicate": rows_agreed - rows_out, "rows_out": rows_out})
    return cl.verify_counts(cl.cleaning_counts(df, fx.DUP_FEATURES, "label"), saved)


# ---- projections and predicates --------------------------------------------------------------

@query("p01_split_predictors", fx.with_sql(M, body="""
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(sum(f_qty), 2) AS qty, round(sum(f_disc), 2) AS disc
FROM fmain"""))
def p01(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_raw(spark, sf)
    features = cl.feature_columns(m, "label", ["row_id"])
    return m.select(*features, "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.round(F.sum("f_qty"), 2).alias("qty"),
        F.round(F.sum("f_disc"), 2).alias("disc"))


# Totals are summed as decimals: exact, so they do not depend on the order of the rows.
@query("p02_numeric_columns", "SELECT " + ", ".join(
    f"CAST(sum(CAST({c} AS DECIMAL(18, 2))) AS DOUBLE) AS {c}" for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + " FROM lineitem")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.table(spark, sf, "lineitem")
    return t.agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c) for c in cl.numeric_columns(t)])


@query("p03_recode_label", """
SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label,
       CASE WHEN l_returnflag = 'R' THEN 'positive' ELSE 'negative' END AS clase, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    d = cl.recode_label(fx.table(spark, sf, "lineitem"), "l_returnflag", "R")
    name = F.when(F.col("label") == 1, "positive").otherwise("negative")
    return d.groupBy("label", name.alias("clase")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_sentinel_to_null", fx.with_sql(M, body="""
SELECT n AS sentinel_cells, n AS null_cells, true AS conserved FROM (
  SELECT count(*) FILTER (WHERE f_age = -1) + count(*) FILTER (WHERE f_age2 = -1) AS n FROM fmain)"""))
def p04(spark: SparkSession, sf: str) -> DataFrame:
    return cl.sentinel_conservation(fx.main_raw(spark, sf), fx.FEATURES)


def three_sets(spark: SparkSession, sf: str, learnable: bool = False) -> dict[str, DataFrame]:
    """Three 'datasets' with their own column names: the main table cut by shipping years."""
    t = fx.model_raw(spark, sf) if learnable else fx.main_raw(spark, sf)
    names = {"d1": ("qty_a", "price_a", "disc_a"), "d2": ("q", "p", "d"), "d3": ("Size", "Amount", "Rebate")}
    year = {"d1": F.col("f_age").between(0, 2555), "d2": F.col("f_age") > 2555, "d3": F.col("f_age") == -1}
    return {
        k: t.filter(year[k]).select("row_id", "label", F.col("f_qty").alias(a), F.col("f_price").alias(b),
                                    F.col("f_disc").alias(c))
        for k, (a, b, c) in names.items()
    }


MEANING = {"d1": {"size": "qty_a", "amount": "price_a", "rebate": "disc_a"},
           "d2": {"size": "q", "amount": "p", "rebate": "d"},
           "d3": {"size": "Size", "amount": "Amount", "rebate": "Rebate"}}
SQL_THREE = """f3 AS (SELECT CASE WHEN f_age = -1 THEN 'd3' WHEN f_age <= 2555 THEN 'd1' ELSE 'd2' END AS conjunto, *
  FROM fmain)"""


def aligned_sets(spark: SparkSession, sf: str, learnable: bool = False) -> dict[str, DataFrame]:
    return {k: cl.align(d, MEANING[k], keep=["row_id", "label"]) for k, d in three_sets(spark, sf, learnable).items()}


@query("p05_align_by_meaning", fx.with_sql(M, SQL_THREE, body="""
SELECT conjunto, count(*) AS n, round(avg(f_qty), 6) AS size, round(avg(f_price), 6) AS amount,
       round(avg(f_disc), 6) AS rebate FROM f3 GROUP BY conjunto"""))
def p05(spark: SparkSession, sf: str) -> DataFrame:
    frames = [d.withColumn("conjunto", F.lit(k)) for k, d in aligned_sets(spark, sf).items()]
    return files.union_all(frames).groupBy("conjunto").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("size", "amount", "rebate")])


URL_COLS = adapters.url_feature_names()
_URL_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(URL_COLS))


@query("p06_column_families", f"""
SELECT variable, CASE WHEN variable LIKE '%\\_url' ESCAPE '\\' THEN 'url' WHEN variable LIKE '%\\_domain' ESCAPE '\\' THEN 'domain'
  WHEN variable LIKE '%\\_directory' ESCAPE '\\' THEN 'directory' WHEN variable LIKE '%\\_file' ESCAPE '\\' THEN 'file'
  WHEN variable LIKE '%\\_params' ESCAPE '\\' THEN 'params' ELSE 'external' END AS family,
  regexp_matches(variable, '^(qty_|length_|directory_|file_|params_|domain_length)') AS controllable,
  (SELECT count(*) FROM pages) AS rows
FROM (VALUES {_URL_VALUES}) t(idx, variable)""")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.urls(spark, sf)
    c = cat.column_catalog(spark, cl.feature_columns(df, "label", ["page_id"]))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return c.select("variable", cat.family(F.col("variable")).alias("family"),
                    cat.is_controllable(F.col("variable")).alias("controllable")).join(F.broadcast(rows))


@query("p07_project_subset", fx.with_sql(M, fx.SQL_NULL, fx.SQL_SPLIT, body="""
SELECT split, round(avg((f_qty - mu) / sd), 6) AS f_qty_scaled, round(avg(f_qty), 6) AS f_qty, count(*) AS n
FROM fsplit, (SELECT avg(f_qty) AS mu, stddev_pop(f_qty) AS sd FROM fsplit WHERE split = 'train') GROUP BY split"""))
def p07(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.preprocess import ColumnScaler

    df = fx.split_main(spark, sf).select("split", "f_qty", "label")
    scaled = ColumnScaler(["f_qty"]).fit(df.filter("split = 'train'"))
    both = df.withColumn("raw", F.col("f_qty"))
    return scaled.transform(both).groupBy("split").agg(
        F.round(F.avg("f_qty"), 6).alias("f_qty_scaled"), F.round(F.avg("raw"), 6).alias("f_qty"),
        F.count(F.lit(1)).alias("n")).withColumn("f_qty_scaled", F.col("f_qty_scaled") + 0.0)


@query("p08_confusion_cells", fx.with_sql(M, fx.SQL_PRED, body="""
SELECT CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 1 THEN 'FN' WHEN pred = 1 THEN 'FP' ELSE 'TN' END AS cell,
       count(*) AS n FROM fpred GROUP BY 1"""))
def p08(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.metrics import confusion_cell

    return fx.predictions(spark, sf).groupBy(confusion_cell().alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_threshold_filter", fx.with_sql(M, body="""
SELECT count(*) AS n, round(avg(f_qty), 6) AS qty FROM fmain WHERE f_disc >= 0.05 AND NOT starts_with(row_id, '0')"""))
def p09(spark: SparkSession, sf: str) -> DataFrame:
    return fx.main_raw(spark, sf).filter((F.col("f_disc") >= 0.05) & ~F.col("row_id").startswith("0")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("f_qty"), 6).alias("qty"))


SQL_URL = """furl AS (
  SELECT page_id, url, CAST(starts_with(url, 'https') AS INTEGER) AS label,
         regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS domain,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '[?]([^#]*)', 1) AS params, contains(url, '?') AS has_params FROM pages),
furl2 AS (SELECT *, regexp_extract(path, '^(.*/)[^/]*$', 1) AS directory, regexp_extract(path, '([^/]*)$', 1) AS file FROM furl),
furl3 AS (SELECT page_id, label, CAST(length(url) AS DOUBLE) AS length_url, CAST(length(domain) AS DOUBLE) AS domain_length,
  CAST(CASE WHEN path <> '' THEN length(directory) ELSE -1 END AS DOUBLE) AS directory_length,
  CAST(CASE WHEN path <> '' THEN length(file) ELSE -1 END AS DOUBLE) AS file_length,
  CAST(CASE WHEN has_params THEN length(params) ELSE -1 END AS DOUBLE) AS params_length,
  CAST(length(url) - length(replace(url, '/', '')) AS DOUBLE) AS qty_slash_url,
  CAST(length(url) - length(replace(url, '?', '')) AS DOUBLE) AS qty_questionmark_url,
  CAST(length(url) - length(replace(url, '=', '')) AS DOUBLE) AS qty_equal_url,
  CAST(length(url) - length(replace(url, '&', '')) AS DOUBLE) AS qty_and_url,
  CAST(length(domain) - length(replace(domain, '.', '')) AS DOUBLE) AS qty_dot_domain,
  CAST(CASE WHEN has_params THEN length(params) - length(replace(params, '=', '')) ELSE -1 END AS DOUBLE) AS qty_equal_params,
  CAST(CASE WHEN path <> '' THEN length(file) - length(replace(file, '.', '')) ELSE -1 END AS DOUBLE) AS qty_dot_file,
  CAST(length(regexp_replace(domain, '[^aeiouAEIOU]', '', 'g')) AS DOUBLE) AS qty_vowels_domain
  FROM furl2)"""
URL_CHECKED = ["length_url", "domain_length", "directory_length", "file_length", "params_length", "qty_slash_url",
               "qty_questionmark_url", "qty_equal_url", "qty_and_url", "qty_dot_domain", "qty_equal_params",
               "qty_dot_file", "qty_vowels_domain"]


@query("p10_physical_consistency", fx.with_sql(SQL_URL, body="""
SELECT label, count(*) AS n, count(*) FILTER (WHERE length_url >= directory_length + file_length + params_length) AS consistent
FROM furl3 GROUP BY label"""))
def p10(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.robust import consistent

    df = fx.urls(spark, sf)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(consistent(df)).alias("consistent"))


SQL_HTML = """fhtml AS (
  SELECT page_id, CAST(starts_with(url, 'https') AS INTEGER) AS label,
    CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS DOUBLE) AS LineOfCode,
    CAST(list_max(list_transform(string_split(html, chr(10)), lambda x: length(x))) AS DOUBLE) AS LargestLineLength,
    CAST(len(regexp_extract_all(html, '(?i)<img')) AS DOUBLE) AS NoOfImage,
    CAST(len(regexp_extract_all(html, '(?i)<style|rel=.?stylesheet')) AS DOUBLE) AS NoOfCSS,
    CAST(len(regexp_extract_all(html, '(?i)<script')) AS DOUBLE) AS NoOfJS,
    CAST(len(regexp_extract_all(html, '(?i)href=.[/#]')) AS DOUBLE) AS NoOfSelfRef,
    CAST(len(regexp_extract_all(html, '(?i)href=.https?:')) AS DOUBLE) AS NoOfExternalRef,
    CAST(CAST(regexp_matches(html, '(?i)<title>[^<]') AS INTEGER) AS DOUBLE) AS HasTitle,
    CAST(CAST(regexp_matches(html, '(?i)rel=.?(shortcut )?icon') AS INTEGER) AS DOUBLE) AS HasFavicon,
    CAST(CAST(regexp_matches(html, '(?i)name=.?description') AS INTEGER) AS DOUBLE) AS HasDescription,
    CAST(CAST(regexp_matches(html, '(?i)copyright|&copy;') AS INTEGER) AS DOUBLE) AS HasCopyrightInfo,
    CAST(CAST(regexp_matches(html, '(?i)facebook|twitter|instagram|linkedin') AS INTEGER) AS DOUBLE) AS HasSocialNet,
    CAST(CAST(regexp_matches(html, '(?i)name=.?viewport') AS INTEGER) AS DOUBLE) AS IsResponsive,
    CAST(CAST(regexp_matches(html, '(?i)type=.?submit') AS INTEGER) AS DOUBLE) AS HasSubmitButton
  FROM pages)"""


def emptiness_flags() -> dict:
    zero = lambda *cs: [F.col(c) == 0 for c in cs]
    a, b, c = zero("HasTitle", "HasFavicon", "HasDescription")
    d, e, f = zero("NoOfImage", "NoOfCSS", "NoOfJS")
    return {"no title, icon or description": a & b & c, "no images, styles or scripts": d & e & f,
            "under 50 lines": F.col("LineOfCode") < 50}


@query("p11_content_emptiness", fx.with_sql(SQL_HTML, body="""
SELECT label, 'no title, icon or description' AS indicator,
       round(avg(CAST(HasTitle = 0 AND HasFavicon = 0 AND HasDescription = 0 AS INTEGER)) * 100, 6) AS pct FROM fhtml GROUP BY label
UNION ALL SELECT label, 'no images, styles or scripts',
       round(avg(CAST(NoOfImage = 0 AND NoOfCSS = 0 AND NoOfJS = 0 AS INTEGER)) * 100, 6) FROM fhtml GROUP BY label
UNION ALL SELECT label, 'under 50 lines', round(avg(CAST(LineOfCode < 50 AS INTEGER)) * 100, 6) FROM fhtml GROUP BY label"""))
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return pr.emptiness_by_class(fx.html(spark, sf), "label", emptiness_flags()).select(
        "label", "indicator", F.round("pct", 6).alias("pct"))


@query("p13_descriptive_median_fill", fx.with_sql(M, fx.SQL_NULL, body="""
SELECT round(avg(coalesce(f_age, m1)), 6) AS f_age, round(avg(coalesce(f_age2, m2)), 6) AS f_age2
FROM fnull, (SELECT median(f_age) AS m1, median(f_age2) AS m2 FROM fnull)"""))
def p13(spark: SparkSession, sf: str) -> DataFrame:
    filled = cl.fill_with_medians(fx.main_null(spark, sf), fx.FEATURES)
    return filled.agg(F.round(F.avg("f_age"), 6).alias("f_age"), F.round(F.avg("f_age2"), 6).alias("f_age2"))


@query("p14_exclude_unknown_age", fx.with_sql(M, body="""
SELECT label, count(*) AS n FROM fmain WHERE f_age <> -1 GROUP BY label"""))
def p14(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.preprocess import ColumnImputer

    df = fx.main_null(spark, sf)
    filled = ColumnImputer(["f_age"], "median", indicators=True).fit(df).transform(df)
    return filled.filter(F.col("missingindicator_f_age") == 0).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- joins -----------------------------------------------------------------------------------

SQL_GROUPS = """g AS (SELECT l_linenumber, l_discount, l_tax, l_quantity, count(*) AS n, count(DISTINCT label) AS k,
  min(label) AS lo, max(label) AS hi FROM fdup GROUP BY l_linenumber, l_discount, l_tax, l_quantity)"""


@query("j01_group_statistic_to_rows", fx.with_sql(fx.SQL_DUP, SQL_GROUPS, body="""
SELECT k AS n_labels, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY k"""))
def j01(spark: SparkSession, sf: str) -> DataFrame:
    rows = cl.labels_per_group(fx.dup(spark, sf), fx.DUP_FEATURES, "label")
    return rows.groupBy("n_labels").agg(F.count(F.lit(1)).alias("n"))


@query("j02_drop_contradictions", fx.with_sql(fx.SQL_DUP, SQL_GROUPS, body="""
SELECT g.l_linenumber, g.l_discount, g.l_tax, g.l_quantity, lo AS label, n FROM g WHERE lo = hi"""))
def j02(spark: SparkSession, sf: str) -> DataFrame:
    kept = cl.drop_contradictions(fx.dup(spark, sf), fx.DUP_FEATURES, "label")
    return kept.groupBy(*fx.DUP_FEATURES, "label").agg(F.count(F.lit(1)).alias("n"))


@query("j03_join_labels_by_key", """
SELECT l.toxic AS label, count(*) AS n, round(avg(d.n_chars), 6) AS chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels")
    joined = d.select("doc_id", "n_chars").join(lab.select("doc_id", "toxic"), "doc_id")
    return joined.groupBy(F.col("toxic").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"))


@query("j06_variable_pairs", fx.with_sql(fx.SQL_MAIN, body="SELECT a.i, b.j, a.v AS a, b.v AS b, (SELECT count(*) FROM fmain) AS rows FROM "
       + f"(SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(fx.FEATURES))}) t(i, v)) a JOIN "
       + f"(SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(fx.FEATURES))}) t(j, v)) b ON a.i < b.j"))
def j06(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_raw(spark, sf)
    pairs = cat.variable_pairs(cat.column_catalog(spark, cl.feature_columns(m, "label", ["row_id"])))
    return pairs.join(F.broadcast(m.agg(F.count(F.lit(1)).alias("rows"))))


@query("w01_exact_dedup", fx.with_sql(fx.SQL_DUP, body="SELECT DISTINCT * FROM fdup"))
def w01(spark: SparkSession, sf: str) -> DataFrame:
    return cl.drop_duplicate_rows(fx.dup(spark, sf))


@query("w01_clean_dedup_and_conflicts", fx.with_sql(fx.SQL_DUP, SQL_GROUPS, body="""
SELECT l_linenumber, l_discount, l_tax, l_quantity, lo AS label FROM g WHERE lo = hi"""))
def w01b(spark: SparkSession, sf: str) -> DataFrame:
    return cl.clean(fx.dup(spark, sf), fx.DUP_FEATURES, "label")


# ---- set operations and scalar functions -----------------------------------------------------

@query("u01_union_all", fx.with_sql(M, fx.SQL_NULL, fx.SQL_SPLIT, body="""
SELECT label, count(*) AS n, round(sum(f_qty), 2) AS qty FROM fsplit GROUP BY label"""))
def u01(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.split_main(spark, sf)
    both = files.union_all([s.filter("split = 'train'"), s.filter("split = 'test'")])
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f_qty"), 2).alias("qty"))


SQL_SUPP = "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = '{a}' AND l_discount = {d}"


@query("u02_intersection", SQL_SUPP.format(a="R", d=0.1) + " INTERSECT " + SQL_SUPP.format(a="A", d=0.0))
def u02(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.table(spark, sf, "lineitem")
    return t.filter("l_returnflag = 'R' AND l_discount = 0.1D").select("l_suppkey").intersect(
        t.filter("l_returnflag = 'A' AND l_discount = 0D").select("l_suppkey"))


@query("u03_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT "
       "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.table(spark, sf, "lineitem")
    return t.filter("l_returnflag = 'R'").select("l_partkey").subtract(
        t.filter("l_returnflag = 'A'").select("l_partkey"))


@query("u04_distinct_values", fx.with_sql(M, fx.SQL_PRED, body="SELECT DISTINCT score FROM fpred"))
def u04(spark: SparkSession, sf: str) -> DataFrame:
    return fx.predictions(spark, sf).select("score").distinct()


@query("f01_scalar_functions", fx.with_sql(M, body="""
SELECT row_id, coalesce(nullif(f_age, -1), 0) AS filled, abs(f_age - 3000) AS dist, greatest(f_qty - 20, 0) AS clipped,
  (1 - 0.25) * f_qty + 0.25 * 10 AS moved,
  CASE WHEN f_qty BETWEEN 0 AND 10 THEN '0-10' WHEN f_qty <= 25 THEN '10-25' WHEN f_qty <= 50 THEN '25-50' END AS bin,
  CASE WHEN f_quasi = 0 THEN 0 ELSE f_qty / f_quasi END AS ratio,
  starts_with(row_id, 'a') AS pre, ends_with(row_id, 'f') AS suf, contains(row_id, '00') AS sub,
  replace(row_id, 'a', '_') AS swapped, ltrim(row_id, '0') AS trimmed
FROM fmain"""))
def f01(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.main_raw(spark, sf)
    return m.select(
        "row_id", F.coalesce(fn.null_if("f_age", -1), F.lit(0.0)).alias("filled"),
        F.abs(F.col("f_age") - 3000).alias("dist"), F.greatest(F.col("f_qty") - 20, F.lit(0.0)).alias("clipped"),
        fn.interpolate(F.col("f_qty"), F.lit(10.0), F.lit(0.25)).alias("moved"),
        fn.right_closed_bin(F.col("f_qty"), [0, 10, 25, 50], ["0-10", "10-25", "25-50"]).alias("bin"),
        fn.safe_ratio(F.col("f_qty"), F.col("f_quasi")).alias("ratio"),
        F.col("row_id").startswith("a").alias("pre"), F.col("row_id").endswith("f").alias("suf"),
        F.col("row_id").contains("00").alias("sub"), F.replace("row_id", F.lit("a"), F.lit("_")).alias("swapped"),
        F.ltrim("row_id", F.lit("0")).alias("trimmed"))


@query("f05_sorted_join_of_strings", """
SELECT l_linenumber, string_agg(s, ' / ' ORDER BY s) AS flags FROM (
  SELECT DISTINCT l_linenumber, l_returnflag || l_linestatus AS s FROM lineitem) GROUP BY l_linenumber""")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.table(spark, sf, "lineitem")
    pairs = t.select("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("s")).distinct()
    return pairs.groupBy("l_linenumber").agg(fn.joined_sorted(F.col("s")).alias("flags"))


@query("f06_json_round_trip", fx.with_sql(M, body="SELECT row_id, f_qty, label FROM fmain"))
def f06(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.main_raw(spark, sf).select("row_id", F.to_json(F.struct("f_qty", "label")).alias("j"))
    return j.select("row_id", F.from_json("j", "f_qty double, label int").alias("r")).select("row_id", "r.*")


@query("f07_iso_timestamp", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS month_start, count(*) AS n FROM orders GROUP BY 1""")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders")
    return o.groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(
        "month_start")).agg(F.count(F.lit(1)).alias("n"))


@query("f09_number_grid", fx.with_sql(M, body="""
SELECT threshold, count(*) FILTER (WHERE f_disc * 10 >= threshold) AS n FROM fmain,
  (SELECT round(CAST(0.05 AS DOUBLE) + CAST(0.01 AS DOUBLE) * i, 12) AS threshold FROM range(91) t(i)) GROUP BY threshold"""))
def f09(spark: SparkSession, sf: str) -> DataFrame:
    counts = fx.main_raw(spark, sf).groupBy((F.col("f_disc") * 10).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    grid = fn.number_grid(counts, "threshold", 0.05, 0.95, 91)
    return grid.groupBy("threshold").agg(
        F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("n"))


@query("f10_quantiles", fx.with_sql(M, fx.SQL_NULL, body=" UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS q FROM fnull"
    for c in fx.FEATURES for p in (0.025, 0.25, 0.5, 0.7, 0.975))))
def f10(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.distribution import exact_quantiles

    q = exact_quantiles(fx.main_null(spark, sf), fx.FEATURES, [0.025, 0.25, 0.5, 0.7, 0.975])
    return q.select("variable", "p", F.round("q", 6).alias("q"))


# ---- adapters --------------------------------------------------------------------------------

@query("adapter_url_features", fx.with_sql(SQL_URL, body="SELECT page_id, label, " + ", ".join(URL_CHECKED) + " FROM furl3"))
def adapter_url(spark: SparkSession, sf: str) -> DataFrame:
    return fx.urls(spark, sf).select("page_id", "label", *URL_CHECKED)


@query("adapter_html_features", fx.with_sql(SQL_HTML, body="SELECT * FROM fhtml"))
def adapter_html(spark: SparkSession, sf: str) -> DataFrame:
    return fx.html(spark, sf)
