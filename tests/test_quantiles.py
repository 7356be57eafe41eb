"""Quantiles of a whole table: cells of ordered keys, refined where a rank falls."""

import numpy as np
import pytest

from tabsieve.operators import distribution as di
from tabsieve.operators import split as sp


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["wide", "narrow", "signs", "few", "infinite"])
def test_quantiles_do_not_unpivot_the_table(spark, name):
    rng = np.random.default_rng(5)
    x = {"wide": rng.lognormal(0, 30, 3000), "narrow": 1.7e15 + rng.integers(0, 10**6, 3000), "signs": rng.normal(size=3000),
         "few": rng.integers(-2, 3, 3000) * 0.5, "infinite": np.concatenate([np.full(40, -np.inf), rng.normal(size=2960)])}[name]
    rows = [(float(v),) for v in x] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    out = di.exact_quantiles(df, ["x"], probs)
    assert "Expand" not in plan(out) and "Unpivot" not in plan(out)
    got = {r["p"]: r["q"] for r in out.collect()}
    s = np.sort(x)
    for p in probs:
        k = p * (len(s) - 1)
        lo, hi = s[int(np.floor(k))], s[int(np.ceil(k))]
        assert got[p] == lo + (hi - lo) * (k - np.floor(k)) or np.isnan(got[p]) and np.isinf(lo)


def test_cuts_do_not_depend_on_the_number_of_buckets(spark):
    df = spark.range(4000).selectExpr("id row_id", "cast(id % 7 = 0 as int) label")
    ranks = lambda n: sp.F.array(sp.F.floor(n / 3).cast("bigint"), sp.F.floor(n * 2 / 3).cast("bigint"))
    found = [sorted(map(tuple, ((r["label"], tuple(r["cuts"])) for r in sp.hash_cuts(df, ["label"], ["row_id"], 42, ranks, digits=d).collect())))
             for d in (1, sp.PREFIX_DIGITS, 4)]
    assert found[0] == found[1] == found[2]
