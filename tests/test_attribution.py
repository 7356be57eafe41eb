"""Attribution at size: what is shuffled is the rows, not their altered copies."""

import numpy as np
import pytest
from pyspark.ml import Model
from pyspark.sql import functions as F

from tabsieve.operators import explain as ex


class Product(Model):
    """score = a * b + c"""

    def _transform(self, dataset):
        return dataset.withColumn("score", F.col("a") * F.col("b") + F.col("c")).withColumn("pred", (F.col("score") > 0.5).cast("int"))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, *(float(x) for x in rng.random(3))) for i in range(300)]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double").repartition(4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shapley_shuffles_rows_once_and_carries_values(table):
    v = ex.shapley(Product(), table, table, ["a", "b", "c"], permutations=4, background_size=20)
    assert plan(v).count("Exchange") == 1 and "Window" not in plan(v)
    got = v.groupBy("row_id").agg(F.sum("contribution").alias("s"), F.max("base").alias("b"), F.max("score").alias("f")).collect()
    assert len(got) == 300 and all(abs(r["b"] + r["s"] - r["f"]) < 1e-12 for r in got)
    own = {r["row_id"]: r for r in table.collect()}
    cells = ex.dependence(v, table, ["a", "c"]).collect()
    assert len(cells) == 600 and all(r["value"] == own[r["row_id"]][r["variable"]] for r in cells)


def test_pair_interactions_shuffle_rows_once(table, spark):
    found = ex.pair_interactions(Product(), table, table, ["a", "b", "c"], draws=2, background_size=20)
    inner = plan(found)
    assert "Join" not in inner and inner.count("Exchange") == 2  # the rows, and the sums by pair
    got = {(r["a"], r["b"]): r["mean_abs"] for r in found.collect()}
    assert got["a", "b"] > 0.01 and got["a", "c"] < 1e-12 and got["b", "c"] < 1e-12


def test_pair_interactions_of_many_columns(table):
    wide = table.select("*", *[(F.col("c") * i).alias(f"x{i}") for i in range(12)])  # 15 columns: 121 sets
    names = ["a", "b", "c", *[f"x{i}" for i in range(12)]]
    got = {(r["a"], r["b"]): r["mean_abs"] for r in ex.pair_interactions(Product(), wide, wide, names, draws=1).collect()}
    assert len(got) == 105 and got["a", "b"] > 0.01 and got["c", "x3"] < 1e-12


def test_permutation_rows_are_shuffled_once(table, monkeypatch):
    seen = []
    real = ex.confusion

    def spy(df, *args, **kw):
        seen.append(df)
        return real(df, *args, **kw)

    monkeypatch.setattr(ex, "confusion", spy)
    monkeypatch.setattr(ex, "ROWS_PER_BUCKET", 50)
    got = ex.permutation_importance(Product(), table, ["a", "b", "c"], repeats=2).collect()
    assert len(got) == 3
    altered = plan(seen[-1])
    assert "row_number" not in altered and "SortMergeJoin" not in altered  # only the window of the next row sorts the rows
