"""Frequent values without value histograms, and the tree of cells of the neighbour join."""

import collections
import random

import numpy as np
import pandas as pd
import pytest

from tabsieve.operators import knn
from tabsieve.operators import profile as pr
from tabsieve.operators.distribution import heavy_hitters
from tabsieve.operators.select import variance_filter


@pytest.fixture(scope="module")
def columns():
    rng = random.Random(4)
    n = 3000
    nan = float("nan")
    return {
        "constant": [7.0] * n, "quasi": [1.0] * (n - 20) + [float(i) for i in range(20)],
        "nulls": [None if i % 3 else float(i) for i in range(n)], "unique": [float(i) for i in range(n)],
        "pairs": [float(i // 2) for i in range(n)], "zero": [rng.choice([0.0, -0.0, 5.0]) for _ in range(n)],
        "nan": [rng.choice([nan, 1.0, None]) for _ in range(n)], "flag": [rng.choice([0.0, 1.0, None]) for _ in range(n)],
        "skewed": [float(int(rng.paretovariate(1.1))) for _ in range(n)], "empty": [None] * n,
        "ten": [float(i % 10) for i in range(n)], "eleven": [float(i % 11) for i in range(n)]}


@pytest.fixture(scope="module")
def frame(spark, columns):
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(7)


def top(values):
    key = lambda v: "null" if v is None else "nan" if v != v else v + 0.0
    return max(collections.Counter(map(key, values)).values())


@pytest.mark.parametrize("k", [3, 8, 64])
def test_dominance_is_exact(frame, columns, k):
    got = {r.variable: r.dominance for r in pr.dominance(frame, list(columns), k).collect()}
    assert got == pytest.approx({c: top(v) / len(v) for c, v in columns.items()})
    for name, n, total, sure in heavy_hitters(frame, list(columns), k):
        assert total == 3000 and n <= top(columns[name]) and (not sure or n == top(columns[name]))


def test_constancy_and_types(frame, columns):
    kinds = {r.variable: r.kind for r in pr.constancy(frame, list(columns)).collect()}
    assert {c for c, k in kinds.items() if k == "constant"} == {"constant", "empty"}
    assert {c for c, k in kinds.items() if k == "quasi_constant"} == {"quasi"}
    assert "quasi" in variance_filter(frame, list(columns), None)
    types = {r.variable: (r.n_distinct, r.kind) for r in pr.variable_types(frame, list(columns)).collect()}
    assert types["flag"] == (2, "binary") and types["ten"] == (10, "discrete") and types["zero"] == (2, "discrete")
    assert types["eleven"] == types["unique"] == (None, "continuous") and "empty" not in types


def test_no_rows(spark):
    none = spark.createDataFrame([], "a double")
    assert pr.dominance(none, ["a"]).count() == pr.constancy(none, ["a"]).count() == pr.variable_types(none, ["a"]).count() == 0


@pytest.mark.parametrize("holes", [0.0, 0.3])
def test_tree_of_cells_gives_exact_neighbours(spark, monkeypatch, holes):
    for name, value in (("BLOCK", 16), ("LEAF", 24), ("FAN", 4), ("FIRST_LEAVES", 2)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(15, 4))[rng.integers(0, 15, 400)] * 6 + rng.normal(size=(400, 4)), 2)
    x[100:160] = x[100]
    x[rng.random(x.shape) < holes] = np.nan
    cols = ["a", "b", "c", "d"]
    table = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(400), "label": 0, **{c: x[:, i] for i, c in enumerate(cols)}}))
    report = {}
    got = knn.neighbours(table, table, cols, 4, report=report).toPandas().sort_values(["row_id", "rank"])
    both = ~np.isnan(x)[:, None] & ~np.isnan(x)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(both.any(-1), (np.where(both, x[:, None] - x[None], 0.0) ** 2).sum(-1) * 4 / both.sum(-1), np.inf)
    np.fill_diagonal(d, np.inf)
    found = {i: list(g["neighbour"]) for i, g in got.groupby("row_id")}
    for i in range(400):
        order = [j for j in np.lexsort((np.arange(400), d[i])) if np.isfinite(d[i, j])][:4]
        assert np.allclose(np.sort(d[i, found.get(i, [])]), np.sort(d[i, order]))
        if not holes:
            assert found[i] == order
    assert report["leaves"] > 10
    if not holes:
        assert report["visits"] < 0.6 * report["leaves"] * report["queries"]


def test_leaves_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 50)
    rows = spark.range(3000).selectExpr(
        "id", "array(pmod(hash(id), 1000) / 1000.0, pmod(hash(id, 1), 1000) / 1000.0) AS x", "0.0 AS y").selectExpr(
        "id", "cast(x AS array<double>) AS x", "cast(y AS double) AS y")
    tree = knn.build_tree(rows.checkpoint(), 3000, 2)
    sizes = [r["count"] for r in tree.rows.groupBy("cell").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 50 and tree.levels >= 2
