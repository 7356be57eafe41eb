"""Iterative imputation from pattern sums equals the chain of regressions over the rows."""

import numpy as np
import pandas as pd
import pytest

from tabsieve.operators.preprocess import IterativeImputer

COLS = ["a", "b", "c", "d"]


def brute(x, rounds, ridge=1e-6):
    miss = np.isnan(x)
    z = np.where(miss, np.nanmean(x, axis=0), x)
    order = [t for t in np.argsort(miss.sum(0), kind="stable") if miss[:, t].any()]
    for _ in range(rounds):
        for t in order:
            rest = [i for i in range(x.shape[1]) if i != t]
            seen = z[~miss[:, t]]
            cov = np.cov(seen, rowvar=False, bias=True)
            a = cov[np.ix_(rest, rest)]
            beta = np.linalg.solve(a + ridge * np.trace(a) / len(rest) * np.eye(len(rest)), cov[rest, t])
            z[miss[:, t], t] = seen[:, t].mean() + (z[miss[:, t]][:, rest] - seen[:, rest].mean(0)) @ beta
    return z


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) * [1, 20, 0.1, 5] + [100, -7, 3, 0]
    x[rng.random(x.shape) < [0.3, 0.1, 0.2, 0.0]] = np.nan
    return x


@pytest.mark.parametrize("memory", [256 << 20, 0])
def test_equals_the_chain_over_the_rows(spark, table, memory):
    df = spark.createDataFrame(pd.DataFrame(table, columns=COLS).assign(row_id=np.arange(400))).repartition(3)
    df = df.selectExpr("row_id", *[f"nanvl({c}, NULL) AS {c}" for c in COLS])
    rounds = 10 if memory else 2
    out = IterativeImputer(COLS, rounds, memory=memory).fit(df).transform(df).orderBy("row_id").toPandas()[COLS].to_numpy()
    assert np.allclose(out, brute(table, rounds), rtol=1e-7, atol=1e-7)


def test_fit_is_one_pass_over_the_table(spark, table):
    df = spark.createDataFrame(pd.DataFrame(table, columns=COLS)).selectExpr(*[f"nanvl({c}, NULL) AS {c}" for c in COLS])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("iterative", "iterative")
    IterativeImputer(COLS, 10).fit(df)
    jobs = len(tracker.getJobIdsForGroup("iterative"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12  # whatever the number of rounds


def test_nothing_missing_and_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, None)], "a double, b double, c double")
    assert [tuple(r) for r in IterativeImputer(["a", "b"]).fit(df).transform(df.select("a", "b")).collect()] == [(1.0, 2.0), (2.0, 4.0)]
    assert [r.c for r in IterativeImputer(["a", "b", "c"]).fit(df).transform(df).collect()] == [0.0, 0.0]
