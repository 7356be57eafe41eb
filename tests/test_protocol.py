"""The registered model queries run the whole lists and budgets of the protocol (nothing is fitted here)."""

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import balance as ba
from tabsieve.operators import evaluate as ev
from tabsieve.operators import models as mo
from tabsieve.plans import REGISTERED, preparation
from tabsieve.plans import modelling as ml


class Stop(Exception):
    pass


@pytest.fixture
def calls(monkeypatch):
    """What a query asks of its operators; every table is None."""
    seen = []
    monkeypatch.setattr(ml, "prepared", lambda *a: (None, None, ["x"]))
    monkeypatch.setattr(ml, "_once", lambda spark, name, params, compute: compute())
    monkeypatch.setattr(ml.sp, "stratified_kfold", lambda d, label, k: seen.append(("folds", k)))
    monkeypatch.setattr(mo, "build", lambda name, cols, weighted=False, **kw: (name, kw))
    monkeypatch.setattr(ml.ev, "leaderboard", lambda d, est, *a, **kw: seen.append(("board", est)))
    return seen


def test_boards_hold_every_model_at_its_defaults(calls, monkeypatch):
    monkeypatch.setattr(ml, "union_all", lambda frames: None)
    monkeypatch.setattr(ml.ev, "best_non_dummy", lambda table: None)
    for queries in (("m23_leaderboard_scaled_models", "m23_leaderboard_tree_models"), ("m24_three_best_models",)):
        calls.clear()
        for name in queries:
            REGISTERED[name](None, "")
        found = {n: kw for kind, est in calls if kind == "board" for n, (_, kw) in est.items()}
        assert set(found) == set(mo.REGISTRY) and not any(found.values())
        assert {v for kind, v in calls if kind == "folds"} == {5}


def test_all_schemes_are_compared(calls, monkeypatch):
    monkeypatch.setattr(ml.fx, "docs", lambda *a: None)
    monkeypatch.setattr(ml.ev, "cross_validate", lambda d, est, resample: calls.append(("scheme", est)))
    monkeypatch.setattr(ml.ev, "summarise", lambda d: None)
    monkeypatch.setattr(ml, "union_all", lambda rows: (_ for _ in ()).throw(Stop))
    with pytest.raises(Stop):
        REGISTERED["r14_balancing_comparison"](None, "")
    assert [n for kind, est in calls if kind == "scheme" for n in est] == list(ba.SCHEMES)


def test_searches_have_the_whole_budget(calls, monkeypatch):
    def search(train, factory, points, *a, **options):
        calls.append((factory(**points[0])[0], len({tuple(p.items()) for p in points})))
        raise Stop

    monkeypatch.setattr(ml.ev, "search", search)
    for name, want in (("g04_grid_search", ("lgbm", 16)), ("g05_g07_random_search_history", (ml.SEARCHED[0], 30)),
                       ("g08_tuned_refit", (ml.SEARCHED[0], 30))):
        with pytest.raises(Stop):
            REGISTERED[name](None, "")
        assert calls.pop() == want
    assert set(ml.SEARCHED) == set(mo.SPACES)
    monkeypatch.setattr(ml.ev, "nested_cv", lambda train, factory, sampler, outer, inner, **kw: (len(sampler(1)), outer, inner))
    assert REGISTERED["g09_nested_cv"](None, "") == (10, 5, 3)


def test_iterative_imputation_has_ten_rounds(monkeypatch):
    def fit(self, df):
        assert self.max_iter == 10
        raise Stop

    class Table:
        def select(self, *a):
            return self

    monkeypatch.setattr(preparation.fx, "main_null", lambda *a: Table())
    monkeypatch.setattr(preparation.pp.IterativeImputer, "fit", fit)
    with pytest.raises(Stop):
        REGISTERED["i08_iterative_impute"](None, "")


def test_knn_imputer_fills_from_training_rows(spark):
    from tabsieve.operators.knn import KnnImputer

    train = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.1, 3.0), (3, 9.0, 50.0), (4, 0.2, None)], "row_id long, a double, b double")
    other = spark.createDataFrame([(9, 0.05, None), (10, 9.0, 7.0)], "row_id long, a double, b double")
    model = KnnImputer(["a", "b"], 2).fit(train)
    assert {r.row_id: r.b for r in model.transform(other).collect()} == {9: 2.0, 10: 7.0}
    assert {r.row_id: r.b for r in model.transform(train).collect()} == {1: 1.0, 2: 3.0, 3: 50.0, 4: 2.0}


def test_stacking_joins_no_rows(spark, monkeypatch):
    """Held scores of all members are read off the same row; the stack is fitted one member after the other when rows are many."""
    table = spark.range(300).select(F.col("id").alias("row_id"), (F.pmod(F.hash("id"), F.lit(10)) > 4).cast("int").alias("label"),
                                    F.pmod(F.hash("id"), F.lit(10)).cast("double").alias("a"))
    monkeypatch.setattr(ev, "out_of_fold", None)  # its long table was grouped by row again
    members = {"logistic": mo.build("logistic", ["a"], max_iter=5), "tree": mo.build("tree", ["a"], depth=2)}
    scored = ev.Stack(members, 2).fit(table).transform(table)
    assert scored.count() == 300 and scored.filter("pred <> label").count() == 0
    assert ev.side_by_side(1000) == ev.PARALLEL and ev.side_by_side(ev.ROWS_SIDE_BY_SIDE) == 1
    plan = ev.holdout(table, table, members["tree"])._jdf.queryExecution().toString()
    assert "parquet" in plan.lower()  # columns, not rows of a checkpoint
