"""Searches that share fits score every trial as a fit of its own would."""

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import evaluate as ev
from tabsieve.operators import models as mo


@pytest.fixture(scope="module")
def table(spark):
    t = spark.range(600).select(
        F.col("id").alias("row_id"), *[(F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(1000)) / 1000).alias(c) for c in "abc"])
    noisy = F.col("a") + F.col("b") * F.col("c") + F.pmod(F.xxhash64(F.lit("n"), "row_id"), F.lit(1000)) / 4000
    return t.withColumn("label", (noisy > 0.9).cast("int")).coalesce(1).persist()


def factory(**p):
    return mo.build("lgbm", ["a", "b", "c"], **p)


def test_smaller_boosters_are_read_off_a_larger_one(table):
    big = factory(iterations=12, depth=3).fit(table)
    rows = {(r.row_id, r.rounds): (r.score, r.pred) for r in big.at(table, [3, 7, 12]).collect()}
    assert len(rows) == 3 * 600
    for n in (3, 7, 12):
        alone = factory(iterations=n, depth=3).fit(table).transform(table).collect()
        assert all(rows[r.row_id, n] == (pytest.approx(r.score, abs=1e-9), r.pred) for r in alone)


def test_search_equals_separate_fits(table):
    points = mo.grid(iterations=[4, 9], leaves=[4, 8], step=[0.1], depth=[3, 5])
    fits = []

    def counted(**p):
        fits.append(p)
        return factory(**p)

    shared = ev.search(table, counted, points, canonical=lambda p: mo.canonical("lgbm", p), grows_by=mo.grows_by("lgbm"))
    assert len(fits) == 2 and {p["iterations"] for p in fits} == {9}  # depth 2 and 3, each with its largest booster
    got = {r.trial: r.value for r in shared.collect()}
    want = {r.trial: r.value for r in ev.search(table, factory, points).collect()}
    assert set(got) == set(range(8)) and got == pytest.approx(want)


def test_leaves_bound_the_depth():
    assert [mo.booster_depth(d, n) for d, n in ((6, 31), (10, 63), (4, 63), (7, None))] == [5, 6, 4, 7]


def test_forests_are_not_shared(table):
    assert mo.grows_by("forest") is None and mo.canonical("forest", {"trees": 3}) == {"trees": 3}


def test_caches_go_when_a_fit_fails(table):
    class Broken(mo.Dummy):
        def _fit(self, dataset):
            raise RuntimeError("broken")

    before = len(table.sparkSession.sparkContext._jsc.getPersistentRDDs())
    for run in (lambda: ev.learning_curve(table, Broken(), 2, 2), lambda: ev.cross_validate(table, {"x": Broken()}, 2),
                lambda: ev.nested_cv(table, lambda **p: Broken(), lambda s: [{}], 2, 2)):
        with pytest.raises(RuntimeError):
            run()
    assert len(table.sparkSession.sparkContext._jsc.getPersistentRDDs()) <= before


def test_perceptron_stops_when_nothing_is_gained(table):
    easy = table.withColumn("label", (F.col("a") > 0.5).cast("int"))
    model = mo.build("mlp_64_32", ["a", "b", "c"], hidden=(4,)).fit(easy)
    assert model.iterations < 200
    right = model.transform(easy).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.95
    assert mo.Perceptron(["a", "b", "c"], (4,), max_iter=20, share=0.0).fit(easy).iterations == 20


def test_repeated_blocks_of_one_table(table):
    from tabsieve.operators import split as sp

    tagged = sp.fold_tags(table, "label", 5, 3)
    assert tagged.count() == 600
    for r in range(3):
        alone = {x.row_id: x.fold for x in sp.stratified_kfold(table, "label", 5, 42 + r).collect()}
        assert {x.row_id: x.folds[r] for x in tagged.collect()} == alone
    oof = ev.out_of_fold(tagged.persist(), {"dummy": mo.Dummy(), "logistic": mo.build("logistic", ["a", "b", "c"])})
    blocks = oof.groupBy("model", "fold").count().collect()
    assert {(r.model, r.fold) for r in blocks} == {(m, b) for m in ("dummy", "logistic") for b in range(15)}
    assert oof.filter("model = 'logistic'").groupBy("row_id").count().filter("count <> 3").count() == 0
    # A block is what a fold of its own split gives.
    one = sp.stratified_kfold(table, "label", 5, 43)
    want = {r.row_id: r.score for r in ev.out_of_fold(one, {"logistic": mo.build("logistic", ["a", "b", "c"])}).filter("fold = 2").collect()}
    got = {r.row_id: r.score for r in oof.filter("model = 'logistic' AND fold = 7").collect()}
    assert got == pytest.approx(want)
