"""The contrast of families compares the protocol's seven models, and all that it fits are in its result."""

from pyspark.sql import functions as F

from tabsieve.operators import models as mo
from tabsieve.plans import REGISTERED
from tabsieve.plans import modelling as ml

PROTOCOL = {"lgbm", "xgb", "forest", "mlp_64_32", "knn_5", "nystroem_svm", "logistic"}
SMALL = {"lgbm": {"iterations": 2}, "xgb": {"iterations": 2, "depth": 2}, "forest": {"trees": 2, "depth": 3}, "tree": {"depth": 3},
         "mlp_64_32": {"hidden": (2,), "max_iter": 10}, "nystroem_svm": {"components": 5, "max_iter": 5}, "logistic": {"max_iter": 5}}


def test_every_family_is_contrasted(spark, monkeypatch):
    h = lambda c: F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(100)) / 100
    table = spark.range(200).select(F.col("id").alias("row_id"), (h("a") + h("n") / 2 > 0.7).cast("int").alias("label"),
                                    h("a").alias("a"), h("b").alias("b")).coalesce(1).persist()
    build, tags = mo.build, ml.sp.fold_tags
    monkeypatch.setattr(ml, "prepared", lambda *a: (table, None, ["a", "b"]))
    monkeypatch.setattr(mo, "build", lambda n, cols, weighted=False, **kw: build(n, cols, weighted, **{**SMALL.get(n, {}), **kw}))
    monkeypatch.setattr(ml.sp, "fold_tags", lambda df, label, k, repeats: tags(df, label, 2, 1) if (k, repeats) == (5, 3) else None)
    rows = REGISTERED["v04_families_contrast"](spark, "").collect()
    seen = {r["model"] for r in rows} | {r["leader"] for r in rows}
    assert seen >= PROTOCOL | {"gaussian_nb", "tree", "lda"} and len(rows) == len(seen) - 1
    table.unpersist()
