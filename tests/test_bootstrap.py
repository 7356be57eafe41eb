"""Replicates kept as arrays equal those of one row per replicate and score."""

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import metrics as mt
from tabsieve.operators.split import bootstrap_counts


def exploded(preds, replicates):
    hist = preds.groupBy("label", "pred", "score").agg(F.count(F.lit(1)).alias("n"))
    drawn = hist.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn(
        "w", bootstrap_counts(F.col("n"), F.col("replicate"), F.col("label"), F.col("pred"), F.col("score"))).filter("w > 0")
    rep, w, y = ["replicate"], F.col("w"), F.col("label").cast("double")
    out = mt.rates_from_counts(mt.confusion(drawn, "label", "pred", rep, w))
    brier = drawn.groupBy("replicate").agg((F.sum(w * (F.col("score") - y) * (F.col("score") - y)) / F.sum(w)).alias("brier"))
    out = out.join(brier, rep).join(mt.area_metrics(mt.score_histogram(drawn, "label", "score", rep, w), rep), rep)
    return mt.metrics_long(out, rep)


@pytest.fixture(scope="module")
def preds(spark):
    score = F.pmod(F.xxhash64("id"), F.lit(37)) / 37
    return spark.range(900).select(
        "id", score.alias("score"), (score + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 200 > 0.7).cast("int").alias("label"),
        (score > 0.5).cast("int").alias("pred")).drop("id").repartition(5)


def test_equal_to_the_exploded_replicates(preds, monkeypatch):
    monkeypatch.setattr(mt, "_DRAWN_ROWS", 7)
    got = {(r.replicate, r.metric): r.value for r in mt.bootstrap_metrics(preds, 40).collect()}
    want = {(r.replicate, r.metric): r.value for r in exploded(preds, 40).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    lo_hi = {r.metric: (r.lo, r.hi) for r in mt.bootstrap_intervals(mt.bootstrap_metrics(preds.coalesce(1), 40)).collect()}
    same = {r.metric: (r.lo, r.hi) for r in mt.bootstrap_intervals(exploded(preds, 40)).collect()}
    assert lo_hi.keys() == same.keys() and all(lo_hi[m] == pytest.approx(same[m]) for m in same)


def test_one_class_and_no_rows(spark, preds):
    ones = {(r.metric): r.value for r in mt.bootstrap_metrics(preds.filter("label = 1"), 1).collect()}
    assert ones["roc_auc"] is None and ones["average_precision"] == pytest.approx(1.0)
    none = mt.bootstrap_metrics(preds.filter("label = 2"), 3)
    assert {r.value for r in none.filter("metric = 'brier'").collect()} == {None}
