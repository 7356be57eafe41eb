"""Labelled tables derived from the given tables, as DataFrames and as the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.sources.files import read_table

FEATURES = ["f_qty", "f_price", "f_disc", "f_tax", "f_line", "f_bin", "f_const", "f_quasi", "f_dup", "f_age", "f_age2"]
CONTINUOUS = ["f_qty", "f_price", "f_disc", "f_tax", "f_line", "f_dup", "f_age", "f_age2"]
DUP_FEATURES = ["l_linenumber", "l_discount", "l_tax", "l_quantity"]
DIMS = 64
DATASETS = {"d1": (1995, 1996), "d2": (1997, 1998), "d3": (1999, 2001)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def main_raw(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, label and the features of one labelled row per order line; -1 marks a missing age."""
    t = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    late = F.col("l_shipdate") >= F.to_timestamp(F.lit("2000-01-01"))
    return t.select(
        F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents)).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("f_qty"),
        F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_disc"),
        F.col("l_tax").alias("f_tax"),
        F.col("l_linenumber").cast("double").alias("f_line"),
        (F.col("l_linestatus") == "F").cast("double").alias("f_bin"),
        F.lit(0.0).alias("f_const"),
        (F.col("l_suppkey") % 200 == 0).cast("double").alias("f_quasi"),
        (F.col("l_quantity") * 2).alias("f_dup"),
        F.when(late, -1.0).otherwise(F.date_diff("l_shipdate", F.lit("1990-01-01")).cast("double")).alias("f_age"),
        F.when(late, -1.0).otherwise(F.month("l_shipdate").cast("double")).alias("f_age2"),
    )


SQL_MAIN = """fmain AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                       CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id,
         CAST(l_returnflag = 'R' AS INTEGER) AS label,
         l_quantity AS f_qty, l_extendedprice AS f_price, l_discount AS f_disc, l_tax AS f_tax,
         CAST(l_linenumber AS DOUBLE) AS f_line,
         CAST(CAST(l_linestatus = 'F' AS INTEGER) AS DOUBLE) AS f_bin,
         CAST(0 AS DOUBLE) AS f_const,
         CAST(CAST(l_suppkey % 200 = 0 AS INTEGER) AS DOUBLE) AS f_quasi,
         l_quantity * 2 AS f_dup,
         CAST(CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN -1
              ELSE date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) END AS DOUBLE) AS f_age,
         CAST(CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN -1 ELSE month(l_shipdate) END AS DOUBLE) AS f_age2
  FROM lineitem)"""


def main_null(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.clean import sentinel_to_null

    return sentinel_to_null(main_raw(spark, sf), FEATURES)


def model_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The main table with a label that models can learn: quantity, price and a missing age raise it, and a
    hash of the row adds noise. About a third of the rows are positive."""
    noise = F.conv(F.substring(F.md5(F.concat(F.lit("label|"), F.col("row_id"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    signal = F.col("f_qty") / 50 * 0.5 + F.col("f_price") / 100000 * 0.3 + (F.col("f_age") == -1).cast("double") * 0.2
    return main_raw(spark, sf).withColumn("label", (signal + noise * 0.3 > 0.7).cast("int"))


def model_null(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.clean import sentinel_to_null

    return sentinel_to_null(model_raw(spark, sf), FEATURES)


def model_split(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.split import stratified_holdout

    return stratified_holdout(model_null(spark, sf), "label")


SQL_NULL = "fnull AS (SELECT row_id, label, " + ", ".join(f"nullif({c}, -1) AS {c}" for c in FEATURES) + " FROM fmain)"


def long_sql(src: str, features: list[str] = FEATURES, name: str = "long", keep: str = "row_id, label") -> str:
    parts = [f"SELECT {keep}, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {src}" for c in features]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def dup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with many exact copies and contradictory labels."""
    return table(spark, sf, "lineitem").select(
        *DUP_FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("label"))


SQL_DUP = ("fdup AS (SELECT l_linenumber, l_discount, l_tax, l_quantity, "
           "CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic predictions table with many tied scores."""
    m = main_raw(spark, sf)
    scored = m.withColumn("score", F.round(0.6 * F.col("f_disc") / 0.1 + 0.4 * F.col("f_qty") / 50, 3))
    return scored.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


SQL_PRED = """fpred AS (
  SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM (
    SELECT *, round(0.6 * f_disc / 0.1 + 0.4 * f_qty / 50, 3) AS score FROM fmain))"""


def split_main(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.split import stratified_holdout

    return stratified_holdout(main_null(spark, sf), "label")


SQL_SPLIT = """fsplit AS (
  SELECT * EXCLUDE (rn, nl), CASE WHEN rn <= round(nl * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', row_id))) AS rn,
               count(*) OVER (PARTITION BY label) AS nl FROM fnull))"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, binary label (one of ten groups against the rest) and the vector components."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def vector_columns(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("row_id", "label", *[F.col("vec")[i].alias(f"v{i}") for i in range(DIMS)])


SQL_VEC = ("fvec AS (SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS label, "
           "CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)")


def urls(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.sources.adapters import url_features

    p = table(spark, sf, "pages").select("page_id", F.col("url").startswith("https").cast("int").alias("label"), "url")
    return url_features(p, "url")


def html(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.sources.adapters import html_features

    p = table(spark, sf, "pages").select("page_id", F.col("url").startswith("https").cast("int").alias("label"), "html")
    return html_features(p, "html")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Punctuation counts of the labelled documents: a small, strongly imbalanced class."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = d.join(lab, "doc_id")
    counts = {"d_comma": ",", "d_dot": "\\.", "d_excl": "!", "d_quest": "\\?", "d_colon": ":", "d_at": "@"}
    return joined.select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"),
        F.col("n_chars").cast("double").alias("d_chars"),
        *[F.regexp_count("text", F.lit(p)).cast("double").alias(n) for n, p in counts.items()])


DOC_FEATURES = ["d_chars", "d_comma", "d_dot", "d_excl", "d_quest", "d_colon", "d_at"]
SQL_DOCS = """fdocs AS (
  SELECT d.doc_id AS row_id, toxic AS label, CAST(n_chars AS DOUBLE) AS d_chars,
         CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS d_comma,
         CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS d_dot,
         CAST(length(text) - length(replace(text, '!', '')) AS DOUBLE) AS d_excl,
         CAST(length(text) - length(replace(text, '?', '')) AS DOUBLE) AS d_quest,
         CAST(length(text) - length(replace(text, ':', '')) AS DOUBLE) AS d_colon,
         CAST(length(text) - length(replace(text, '@', '')) AS DOUBLE) AS d_at
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
