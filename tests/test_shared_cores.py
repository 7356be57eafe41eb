"""Fits that share the cores get a table of few partitions; one stage task leaves several files."""

from pyspark.sql import functions as F

from tabsieve.operators import evaluate as ev
from tabsieve.sources import sinks


def test_partitions_follow_the_fits(spark):
    cores, df = spark.sparkContext.defaultParallelism, spark.range(1000).repartition(12)
    parts = lambda rows, fits: ev.compact(df, rows, fits).rdd.getNumPartitions()
    assert parts(10 * ev.ROWS_A_TASK, 1) == 10
    assert parts(10 * ev.ROWS_A_TASK, 8 * cores) == 1
    assert parts(3 * ev.ROWS_A_FIT, 8 * cores) == 3


def test_a_stage_of_one_task_is_read_by_several(spark, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_A_FILE", 100)
    df = spark.range(1000).coalesce(1)
    files = lambda d: d.select(F.input_file_name()).distinct().count()
    assert files(sinks.written(df, "one")) == 1 and files(sinks.written(df, "many", 1000)) == 10


def test_every_model_has_its_own_resampling(spark):
    """Schemes of one comparison are fitted in one pool; each model sees the training rows of its own scheme."""
    from tabsieve.operators import models as mo

    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.rand(1).alias("a"))
    models = {n: mo.Dummy() for n in ("all", "positives", "unnamed")}
    folds = ev.cross_validate(df, models, 2, resample={"all": lambda t: t, "positives": lambda t: t.filter("label = 1")}, areas=False)
    found = {(r.model, r.fold): (r.tp, r.fp, r.tn) for r in folds.collect()}
    assert set(found) == {(m, f) for m in models for f in (0, 1)}
    assert all(v == ((50, 150, 0) if m == "positives" else (0, 0, 150)) for (m, _), v in found.items())
