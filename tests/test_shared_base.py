"""A table of donors is put into its tree once, however many tables are filled from it."""

from pyspark.sql import functions as F

from tabsieve.operators import knn
from tabsieve.plans import modelling as ml


def test_an_imputer_builds_its_tree_once(spark, monkeypatch):
    monkeypatch.setattr(knn, "CROSS_ROWS", 0)
    monkeypatch.setattr(knn, "LEAF", 100)
    h = lambda c: (F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(50)) / 8).cast("double")
    table = spark.range(700).select(F.col("id").alias("row_id"), h("a").alias("a"), F.when(F.col("id") % 5 > 0, h("b")).alias("b"))
    train, test = table.filter("row_id < 500"), table.filter("row_id >= 500")
    built, build = [], knn.build_tree
    monkeypatch.setattr(knn, "build_tree", lambda *a: built.append(a) or build(*a))
    model = knn.KnnImputer(["a", "b"], 4).fit(train)
    got = [sorted(model.transform(t).collect()) for t in (train, test)]
    assert len(built) == 1
    assert got == [sorted(knn.knn_impute(t, ["a", "b"], 4, donors=train).collect()) for t in (train, test)]
    assert all(r["b"] is not None for rows in got for r in rows) and [len(rows) for rows in got] == [500, 200]


def test_scalers_and_imputers_read_the_base_stage(spark, monkeypatch):
    """The comparison reads the written base, whose rows and folds are those of the table that it is made from."""
    names, seen, written = [], [], ml.written
    monkeypatch.setattr(ml, "written", lambda df, name, *a: names.append(name) or written(df, name, *a))
    monkeypatch.setattr(ml.ev, "leaderboard", lambda folds, est, areas: seen.append((folds, est)))
    ml.e08(spark, "/root/testdata/sf0.001")
    assert names == ["base"] and len(seen[0][1]) == 14
    df = ml.fx.model_split(spark, "/root/testdata/sf0.001").filter("split = 'train'").select("row_id", "label", *ml.USED)
    want = ml.sp.stratified_kfold(df, "label", 5)
    assert sorted(seen[0][0].select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)
