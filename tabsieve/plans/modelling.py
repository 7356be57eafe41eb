"""Queries: neighbours, balancing, models, protocol, attribution and robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.operators import balance as ba
from tabsieve.operators import evaluate as ev
from tabsieve.operators import explain as ex
from tabsieve.operators import knn
from tabsieve.operators import metrics as mt
from tabsieve.operators import models as mo
from tabsieve.operators import preprocess as pp
from tabsieve.operators import profile as pr
from tabsieve.operators import reduce as rd
from tabsieve.operators import robust as rb
from tabsieve.operators import select as se
from tabsieve.operators import split as sp
from tabsieve.operators import stats as st
from tabsieve.operators.choose import best_so_far
from tabsieve.plans import fixtures as fx
from tabsieve.plans.cleaning import aligned_sets
from tabsieve.plans.profiling import rnd
from tabsieve.plans.registry import query
from tabsieve.session import ensure_checkpoint_dir
from tabsieve.sources.files import union_all
from tabsieve.sources.sinks import checkpointed, written

M = fx.SQL_MAIN
USED = ["f_qty", "f_price", "f_disc", "f_tax", "f_line", "f_bin", "f_quasi", "f_age", "f_age2"]
V = fx.SQL_VEC


def prepared(spark: SparkSession, sf: str, scale: str = "standard") -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, columns): split, then median + indicator imputation and scaling fitted on train."""
    done, columns = _prepare(spark, sf, scale)
    return done.filter("split = 'train'").drop("split"), done.filter("split = 'test'").drop("split"), columns


def _base(spark: SparkSession, sf: str, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """The table of the model queries, written once as its keys, labels and orders are hashes."""
    ensure_checkpoint_dir(spark)
    rows = sp.with_order(fx.model_null(spark, sf).select("row_id", "label", *USED), *seeds)
    return written(rows, "base", fx.table(spark, sf, "lineitem").count())


def split_table(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, label, split, the used columns and the order. The split is a comparison of the written order with the cuts:
    reading it off the base costs less than a second table."""
    return sp.stratified_holdout(_base(spark, sf), "label")


def _prepare(spark: SparkSession, sf: str, scale: str) -> tuple[DataFrame, list[str]]:
    df = split_table(spark, sf)
    train = df.filter("split = 'train'")
    imputer = pp.ColumnImputer(USED, "median", indicators=True).fit(train)
    columns = imputer.output
    scaler = pp.ColumnScaler(columns, scale).fit(imputer.transform(train))
    # Imputing and scaling are plain expressions: reading them off the split costs less than a second table.
    return scaler.transform(imputer.transform(df)), columns


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Split -> impute -> scale -> logistic regression -> held-out report."""
    train, test, columns = prepared(spark, sf)
    return mt.binary_metrics(ev.holdout(train, test, mo.build("logistic", columns, max_iter=20)))


@query("g16_holdout_report")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


# ---- neighbours ------------------------------------------------------------------------------

def _near_sql(where: str = "", k: int = 3) -> str:
    return f"""nn AS (SELECT q.row_id, b.row_id AS neighbour, q.label AS yq, b.label AS y, sqrt(list_sum(list_transform(list_zip(q.vec, b.vec),
      lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
    FROM fvec q JOIN fvec b ON q.row_id <> b.row_id {where}),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, neighbour) AS rank FROM nn) WHERE rank <= {k})"""


@query("j09_exact_neighbours", fx.with_sql(V, _near_sql(k=5), body="""
SELECT row_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM near"""))
def j09(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.vectors(spark, sf)
    return rnd(knn.neighbours(v, v, "vec", 5), "distance").select("row_id", "rank", "neighbour", "distance")


@query("r09_tomek_links", fx.with_sql(V, _near_sql(k=1), body="""
SELECT a.row_id AS a, a.neighbour AS b FROM near a JOIN near b ON a.neighbour = b.row_id AND b.neighbour = a.row_id
WHERE a.yq = 1 AND a.y = 0"""))
def r09(spark: SparkSession, sf: str) -> DataFrame:
    return ba.tomek_links(fx.vectors(spark, sf), "vec")


@query("r10_edited_neighbours", fx.with_sql(V, _near_sql("AND q.label = 0", 3), body="""
SELECT row_id, label FROM fvec WHERE row_id NOT IN (SELECT row_id FROM near WHERE y <> 0)"""))
def r10(spark: SparkSession, sf: str) -> DataFrame:
    return ba.edited_neighbours(fx.vectors(spark, sf), "vec").select("row_id", "label")


@query("r11_near_miss", fx.with_sql(V, _near_sql("AND q.label = 0 AND b.label = 1", 3), """
mn AS (SELECT row_id, avg(distance) AS m FROM near GROUP BY row_id)""", body="""
SELECT row_id, label FROM fvec WHERE label = 1 UNION ALL
(SELECT row_id, 0 FROM mn ORDER BY m, row_id LIMIT (SELECT count(*) FROM fvec WHERE label = 1))"""))
def r11(spark: SparkSession, sf: str) -> DataFrame:
    return ba.near_miss(fx.vectors(spark, sf), "vec").select("row_id", "label")


@query("m08_nearest_vote", fx.with_sql(V, _near_sql(k=5), body="""
SELECT row_id, round(avg(y), 6) AS score, CAST(avg(y) > 0.5 AS INTEGER) AS pred FROM near GROUP BY row_id"""))
def m08(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.vectors(spark, sf)
    near = knn.neighbours(v, v, "vec", 5)
    return near.groupBy("row_id").agg(F.round(F.avg("y"), 6).alias("score"),
                                      (F.avg("y") > 0.5).cast("int").alias("pred"))


DIM_COLS = [f"v{i}" for i in range(fx.DIMS)]


@query("i07_knn_impute")
def i07(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.vector_columns(spark, sf)
    holes = v.withColumns({
        c: F.when(F.pmod("row_id", F.lit(7)) != i % 7, F.col(c)) for i, c in enumerate(DIM_COLS)})
    filled = knn.knn_impute(holes, DIM_COLS, 5)
    joined = filled.join(v.select("row_id", *[F.col(c).alias(f"t_{c}") for c in DIM_COLS]), "row_id")
    err = sum((F.abs(F.col(c) - F.col(f"t_{c}")) for c in DIM_COLS[1:]), F.abs(F.col("v0") - F.col("t_v0")))
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.avg(err).alias("mean_abs_error"))


# ---- balancing -------------------------------------------------------------------------------

D = fx.SQL_DOCS


@query("r01_r03_class_weights", fx.with_sql(D, """n AS (SELECT label, count(*) AS c FROM fdocs GROUP BY label)""", body="""
SELECT label, round(sum(c) OVER () / (2.0::DOUBLE * c), 6) AS balanced, CASE WHEN label = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS two,
  CASE WHEN label = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS three, c AS n FROM n"""))
def r01(spark: SparkSession, sf: str) -> DataFrame:
    d = ba.balanced_weights(fx.docs(spark, sf), name="balanced")
    d = ba.fixed_weights(ba.fixed_weights(d, 2.0, name="two"), 3.0, name="three")
    return rnd(d.groupBy("label").agg(*[F.max(c).alias(c) for c in ("balanced", "two", "three")],
                                      F.count(F.lit(1)).alias("n")), "balanced")


SQL_SIZES = """sz AS (SELECT label AS l, count(*) AS c FROM fdocs GROUP BY label),
ext AS (SELECT min(c) AS small, max(c) AS big, arg_min(l, c) AS rare FROM sz),
od AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', row_id))) AS rn FROM fdocs)"""


@query("r07_random_oversample", fx.with_sql(D, SQL_SIZES, body="""
SELECT row_id, label, CASE WHEN label = rare THEN big // small + CAST(rn <= big % small AS INTEGER) ELSE 1 END AS copies FROM od, ext"""))
def r07(spark: SparkSession, sf: str) -> DataFrame:
    return ba.oversample(fx.docs(spark, sf)).groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@query("r08_random_undersample", fx.with_sql(D, SQL_SIZES, body="""
SELECT row_id, label FROM od, ext WHERE label = rare OR rn <= small"""))
def r08(spark: SparkSession, sf: str) -> DataFrame:
    return ba.undersample(fx.docs(spark, sf)).select("row_id", "label")


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.avg("v0").alias("v0"))


@query("r04_smote")
def r04(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(ba.smote(fx.vector_columns(spark, sf), DIM_COLS))


SQL_SIZES = """SELECT label, false AS synthetic, count(*) AS n FROM fvec GROUP BY label UNION ALL
SELECT CAST(c1 < c0 AS INTEGER), true, abs(c0 - c1) FROM (SELECT count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1 FROM fvec)"""


@query("r04_smote_class_sizes", fx.with_sql(V, body=SQL_SIZES))
def r04b(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(ba.smote(fx.vector_columns(spark, sf), DIM_COLS)).drop("v0")


@query("r05_borderline_smote")
def r05(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(ba.borderline_smote(fx.vector_columns(spark, sf), DIM_COLS))


@query("r06_adasyn")
def r06(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(ba.adasyn(fx.vector_columns(spark, sf), DIM_COLS))


@query("r12_smote_tomek")
def r12(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(ba.smote_tomek(fx.vector_columns(spark, sf), DIM_COLS))


@query("r12_smote_enn")
def r12b(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(ba.smote_enn(fx.vector_columns(spark, sf), DIM_COLS))


@query("r13_positive_weight")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    train, test, cols = prepared(spark, sf, "none")
    model = mo.build("hist_gb", cols, weighted=True, iterations=5, depth=3)
    return mt.binary_metrics(ev.holdout(ba.positive_weight(train), test.withColumn("weight", F.lit(1.0)), model))


@query("r14_balancing_comparison")
def r14(spark: SparkSession, sf: str) -> DataFrame:
    d = sp.stratified_kfold(fx.docs(spark, sf), "label", 5)
    est = {name: mo.build("logistic", fx.DOC_FEATURES, weighted=name in ba.WEIGHTED) for name in ba.SCHEMES}
    # All schemes share the cores: their searches for neighbours are chains of short jobs.
    schemes = {name: lambda t, s=scheme: s(t, fx.DOC_FEATURES) for name, scheme in ba.SCHEMES.items()}
    rows = [ev.summarise(ev.cross_validate(d, est, resample=schemes))]
    return union_all(rows).orderBy(F.desc("mcc_mean"), "model")


# ---- models ----------------------------------------------------------------------------------

@query("m01_dummy_majority", fx.with_sql(M, body="""
SELECT row_id, CAST((SELECT avg(label) FROM fmain) > 0.5 AS INTEGER) AS pred FROM fmain"""))
def m01(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.main_raw(spark, sf).select("row_id", "label")
    return mo.Dummy().fit(df).transform(df).select("row_id", "pred")


VECTOR_MODELS = ("knn_5", "knn_15")
SCALED_MODELS = [n for n, (_, _, _, scaled) in mo.REGISTRY.items() if scaled]
TREE_MODELS = [n for n in mo.REGISTRY if n not in SCALED_MODELS]


def _once(spark: SparkSession, name: str, params: dict, compute) -> DataFrame:
    """A table that several queries of a session read, written once below the session's shared folder."""
    return checkpointed(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/shared", name, compute, params=params)


def _board(spark: SparkSession, sf: str, names: list[str], scale: str) -> DataFrame:
    def compute() -> DataFrame:
        train, _, cols = prepared(spark, sf, scale)
        families = {n: mo.REGISTRY[n][0] for n in names}
        return ev.leaderboard(sp.stratified_kfold(train, "label", 5), {n: mo.build(n, cols) for n in names}, families)
    return _once(spark, "board", {"sf": sf, "models": names, "scale": scale}, compute)


@query("m23_leaderboard_scaled_models")
def m23(spark: SparkSession, sf: str) -> DataFrame:
    return _board(spark, sf, SCALED_MODELS, "standard")


@query("m23_leaderboard_tree_models")
def m23b(spark: SparkSession, sf: str) -> DataFrame:
    return _board(spark, sf, TREE_MODELS, "none")


@query("m24_three_best_models")
def m24(spark: SparkSession, sf: str) -> DataFrame:
    return ev.best_non_dummy(union_all([_board(spark, sf, SCALED_MODELS, "standard"), _board(spark, sf, TREE_MODELS, "none")]))


@query("m08_m09_nearest_leaderboard")
def m08b(spark: SparkSession, sf: str) -> DataFrame:
    v = sp.stratified_kfold(fx.vector_columns(spark, sf), "label", 3)
    return ev.leaderboard(v, {n: mo.build(n, DIM_COLS) for n in VECTOR_MODELS})


@query("m20_m21_voting_and_stacking")
def m20(spark: SparkSession, sf: str) -> DataFrame:
    train, test, cols = prepared(spark, sf)
    members = {"logistic": mo.build("logistic", cols, max_iter=10), "tree": mo.build("tree", cols, depth=6)}
    out = []
    for name, est in (("voting", ev.SoftVote(list(members.values()))), ("stacking", ev.Stack(members, 3))):
        out.append(ev.holdout(train, test, est).withColumn("model", F.lit(name)))
    return mt.binary_metrics(union_all(out), by=["model"])


@query("m22_calibration")
def m22(spark: SparkSession, sf: str) -> DataFrame:
    train, test, cols = prepared(spark, sf, "none")
    base = mo.build("tree", cols, depth=6)
    out = [ev.holdout(train, test, base).withColumn("model", F.lit("raw"))]
    for method in ("sigmoid", "isotonic"):
        out.append(ev.holdout(train, test, ev.Calibrated(base, method, 3)).withColumn("model", F.lit(method)))
    return mt.probability_losses(union_all(out), by=["model"])


@query("a36_m25_dataset_audit")
def a36(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    features = ["size", "amount", "rebate"]
    for name, d in aligned_sets(spark, sf, learnable=True).items():
        d = written(d, "set")  # every measure below reads it, and its keys and labels are hashes
        best = pr.best_single_cut(d, features, "label").select(
            F.col("variable").alias("best_variable"), F.col("accuracy").alias("best_accuracy"))
        degenerate = pr.degenerate_features(d, features, "label").agg(
            F.count(F.lit(1)).alias("degenerate"), F.concat_ws(", ", F.sort_array(F.collect_list("variable"))).alias("which"))
        est = {f"depth_{k}": mo.build("tree", features, depth=k) for k in (1, 2, 3)}
        trees = ev.summarise(ev.cross_validate(d, est, 5, areas=False)).groupBy().pivot(
            "model", list(est)).agg(F.first("f1_mean"))
        size = d.agg(F.count(F.lit(1)).alias("rows"))
        row = size.join(F.broadcast(pr.majority_baseline(d, "label"))).join(F.broadcast(best)).join(
            F.broadcast(degenerate)).join(F.broadcast(trees))
        rows.append(row.withColumns({
            "dataset": F.lit(name), "advantage_points": (F.col("best_accuracy") - F.col("majority_accuracy")) * 100}))
    return union_all(rows)


# ---- reduction and selection -----------------------------------------------------------------

def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


@query("d01_d02_principal_components")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    v = _assembled(fx.vector_columns(spark, sf), DIM_COLS).select("row_id", "label", "features")
    kept = rd.PrincipalComponents(variance=0.95).fit(v)
    two = rd.PrincipalComponents(k=2, variance=None).fit(v)
    a = kept.transform(v).agg(F.max(F.size(vector_to_array("pca"))).alias("components_95"))
    xy = vector_to_array("pca")
    b = two.transform(v).agg(F.var_pop(xy[0]).alias("var_1"), F.var_pop(xy[1]).alias("var_2"))
    return a.join(F.broadcast(b)).withColumn("share_kept", F.lit(float(kept.explained[: kept.keep].sum())))


@query("d03_m05_linear_discriminant")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.vector_columns(spark, sf)
    return rd.LinearDiscriminant(DIM_COLS).fit(v).transform(v).groupBy("label").agg(
        F.avg("lda").alias("mean_projection"), F.avg("prediction").alias("predicted_positive"))


@query("d04_nystroem_features")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    v = fx.vector_columns(spark, sf)
    k = rd.Nystroem(DIM_COLS, components=50).fit(v).transform(v)
    arr = vector_to_array("kernel")
    norm = F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x)
    return k.groupBy("label").agg(F.avg(norm).alias("mean_sq_norm"), F.count(F.lit(1)).alias("n"))


@query("d05_representation_comparison")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.vector_columns(spark, sf)
    folds = sp.stratified_kfold(v, "label", 3)
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=DIM_COLS, outputCol="features")
    pca = Pipeline(stages=[assemble, rd.PrincipalComponents(variance=0.9),
                           mo.Linear(LogisticRegression(featuresCol="pca", maxIter=20), "pca")])
    est = {"full": mo.build("logistic", DIM_COLS, max_iter=20), "half": mo.build("logistic", DIM_COLS[:32], max_iter=20),
           "pca": pca, "lda": mo.build("lda", DIM_COLS)}
    return ev.leaderboard(folds, est)


@query("k03_k06_embedded_selection")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    train, _, cols = prepared(spark, sf)
    picks = {"l1": se.select_l1(train, cols, max_iter=20), "forest": se.select_forest(train, cols, trees=10, depth=5),
             "boosted": se.select_boosted(train, cols, iterations=5, depth=3)}
    return spark.createDataFrame([(m, len(c), ", ".join(c)) for m, c in picks.items()],
                                 "method string, n int, columns string")


@query("k05_k07_subset_comparison")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    from tabsieve.operators.choose import most_parsimonious

    train, _, cols = prepared(spark, sf)
    folds = written(sp.stratified_kfold(train, "label", 3), "folds")

    def score(subset: list[str]) -> float:
        est = {"m": mo.build("logistic", subset, max_iter=10)}
        return float(ev.summarise(ev.cross_validate(folds, est, areas=False)).first()["f1_mean"])

    kept, history = se.recursive_elimination(train, cols, score, step=5, max_iter=10)
    sizes = {str(n): n for n, _ in history} | {"kept": len(kept)}
    table = spark.createDataFrame([(k, n, dict(history)[n]) for k, n in sizes.items()],
                                  "subset string, n int, f1 double")
    best = most_parsimonious(table, "subset", "f1", "n").select(F.col("subset").alias("chosen"))
    return table.join(F.broadcast(best))


@query("e08_scaler_and_imputer_comparison")
def e08(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml import Pipeline

    folds = sp.stratified_kfold(split_table(spark, sf).filter("split = 'train'").drop("split"), "label", 5)
    est = {}
    for strategy in ("mean", "median", "most_frequent", "constant"):
        est[f"impute_{strategy}"] = Pipeline(stages=[pp.ColumnImputer(USED, strategy), mo.build("logistic", USED)])
    flags = [f"missingindicator_{c}" for c in ("f_age", "f_age2")]
    for strategy in ("median", "mean"):
        est[f"impute_{strategy}_indicator"] = Pipeline(stages=[
            pp.ColumnImputer(USED, strategy, True), mo.build("logistic", [*USED, *flags])])
    est["impute_knn"] = Pipeline(stages=[knn.KnnImputer(USED, 5), mo.build("logistic", USED)])
    est["impute_iterative"] = Pipeline(stages=[pp.IterativeImputer(USED), mo.build("logistic", USED)])
    for scale in ("none", "standard", "minmax", "maxabs", "robust", "yeo_johnson"):
        est[f"scale_{scale}"] = Pipeline(stages=[
            pp.ColumnImputer(USED, "mean"), pp.ColumnScaler(USED, scale), mo.build("logistic", USED)])
    return ev.leaderboard(folds, est, areas=False)


# ---- protocol --------------------------------------------------------------------------------

@query("g01_g02_cross_validation")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    train, _, cols = prepared(spark, sf)
    return ev.cross_validate(train, {"logistic": mo.build("logistic", cols, max_iter=20)}, 5)


@query("g03_out_of_fold_scores")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    train, _, cols = prepared(spark, sf)
    folds = written(sp.stratified_kfold(train, "label", 5), "folds")  # read by every fit and transform
    oof = ev.out_of_fold(folds, {"tree": mo.build("tree", cols, depth=5)}, 5)
    return oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("rows"),
                                   F.avg("score").alias("mean_score"))


# Fixed values of the protocol: draws of a random search, the searched families, the family of the final model.
TRIALS = 30
SEARCHED = list(mo.SPACES)
FINAL = "lgbm"


def _factory(name: str, cols: list[str]):
    return lambda **p: mo.build(name, cols, **_ints(p))


def _ints(p: dict) -> dict:
    return {k: int(v) if k in ("depth", "iterations", "leaves", "trees", "min_rows", "minInstancesPerNode") else v for k, v in p.items()}


def _options(name: str) -> dict:
    return {"canonical": lambda p: mo.canonical(name, p), "grows_by": mo.grows_by(name)}


def _trials(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, list[dict]]:
    """The trial table of a family's random search: written once, read by the history and by the refit."""
    points = mo.sample_space(mo.SPACES[name], TRIALS)

    def compute() -> DataFrame:
        train, _, cols = prepared(spark, sf, "none")
        return ev.search(train, _factory(name, cols), points, **_options(name))
    return _once(spark, "trials", {"sf": sf, "family": name, "points": points}, compute), points


@query("g04_grid_search")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    train, _, cols = prepared(spark, sf, "none")
    points = mo.grid(iterations=[200, 400], leaves=[31, 63], step=[0.05, 0.1], depth=[6, 10])
    return ev.search(train, _factory("lgbm", cols), points, **_options("lgbm"))


@query("g05_g07_random_search_history")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in SEARCHED:
        found = _trials(spark, sf, name)[0].withColumn("family", F.lit(name))
        out = out.unionByName(found, allowMissingColumns=True) if out is not None else found
    return best_so_far(out, "trial", "value", by=["family"])


@query("g08_tuned_refit")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    """The best point of each family is cross-validated on all of train; the best of these is fitted and scored once."""
    train, test, cols = prepared(spark, sf, "none")
    best = {name: ev.best_point(*_trials(spark, sf, name)) for name in SEARCHED}
    tuned = {name: _factory(name, cols)(**point) for name, (point, _) in best.items()}
    name = ev.summarise(ev.cross_validate(train, tuned)).orderBy(F.desc("f1_mean"), "model").first()["model"]
    point, inner = best[name]
    held = mt.binary_metrics(ev.holdout(train, test, tuned[name]))
    return held.withColumns({"model": F.lit(name), "depth": F.lit(point["depth"]), "inner_f1": F.lit(inner)})


@query("g09_nested_cv")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    train, _, cols = prepared(spark, sf, "none")
    return ev.nested_cv(train, _factory(FINAL, cols), lambda s: mo.sample_space(mo.SPACES[FINAL], 10, s), outer=5, inner=3,
                        **_options(FINAL))


@query("g10_learning_curve")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    train, _, cols = prepared(spark, sf, "none")
    return ev.learning_curve(train, mo.build("tree", cols, depth=5), steps=4, k=2)


@query("g11_p12_protocol_replication")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    preds = []
    for name, d in aligned_sets(spark, sf, learnable=True).items():
        tagged = written(sp.stratified_holdout(d, "label"), "holdout")  # read by every fit and transform below
        for drop in (None, "rebate"):
            features = [c for c in ("size", "amount", "rebate") if c != drop]
            train, test = sp.train_test(tagged)
            held = ev.holdout(train, test, mo.build("tree", features, depth=4))
            preds.append(held.withColumns({"dataset": F.lit(name), "without": F.lit(drop or "")}))
    return mt.binary_metrics(union_all(preds), by=["dataset", "without"])


@query("g12_j05_transfer_matrix")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    sets = {k: d.persist() for k, d in aligned_sets(spark, sf, learnable=True).items()}
    out = ev.transfer_matrix(sets, mo.build("tree", ["size", "amount", "rebate"], depth=4))
    for d in sets.values():
        d.unpersist()
    return out


def _seed_scores(spark: SparkSession, sf: str, seeds: list[int], models: dict) -> DataFrame:
    out = []
    base = _base(spark, sf, tuple(seeds))
    for s in seeds:
        own = base.drop(*[c for t in seeds if t != s for c in sp.with_order(base.select("row_id"), t).columns[1:]])
        train, _ = sp.train_test(sp.stratified_holdout(own, "label", seed=s))
        folds = ev.cross_validate(train, models, 3, seed=s, areas=False)
        out.append(folds.groupBy("model").agg(F.avg("f1").alias("value")).withColumn("seed", F.lit(s)))
    return union_all(out)


@query("g13_g15_seed_stability")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml import Pipeline

    flags = [f"missingindicator_{c}" for c in ("f_age", "f_age2")]
    models = {f"{n}_indicator": Pipeline(stages=[pp.ColumnImputer(USED, n, True), mo.build("tree", [*USED, *flags], depth=4)])
              for n in ("median", "mean")}
    ensure_checkpoint_dir(spark)
    scores = _seed_scores(spark, sf, [42, 43, 44, 45, 46], models).withColumn("comparison", F.lit("imputation")).checkpoint()
    return pr.seed_summary(scores, ["model"]).join(
        pr.winner_counts(scores, "comparison", "seed", "model", "value"), "model", "left")


@query("g14_indicator_ablation")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml import Pipeline

    ensure_checkpoint_dir(spark)
    df = _base(spark, sf)
    flags = [f"missingindicator_{c}" for c in ("f_age", "f_age2")]
    est = {
        "median": Pipeline(stages=[pp.ColumnImputer(USED, "median"), mo.build("tree", USED, depth=4)]),
        "median_indicator": Pipeline(stages=[pp.ColumnImputer(USED, "median", True), mo.build("tree", [*USED, *flags], depth=4)]),
        "null_bin": Pipeline(stages=[pp.NullBinEncoder(USED, 16), mo.build("tree", USED, depth=4)]),
    }
    return ev.leaderboard(sp.stratified_kfold(df, "label", 3), est, areas=False)


# The seven models of the protocol's contrast, and with them the Bayesian one, a single tree and the discriminant.
FAMILIES = ("lgbm", "xgb", "forest", "mlp_64_32", "knn_5", "nystroem_svm", "logistic", "gaussian_nb", "tree", "lda")


@query("v04_families_contrast")
def v04(spark: SparkSession, sf: str) -> DataFrame:
    train, _, cols = prepared(spark, sf)
    est = {n: mo.build(n, cols) for n in FAMILIES}
    folds = ev.cross_validate(sp.fold_tags(train, "label", 5, 3), est, areas=False)
    scores = ev.long_scores(folds, "families").checkpoint()
    chi = st.friedman(scores).select("comparison", "chi2", F.col("p").alias("friedman_p"))
    return st.leader_vs_all(scores).join(chi, "comparison")


# ---- attribution -----------------------------------------------------------------------------

def _explained(spark: SparkSession, sf: str):
    train, test, cols = prepared(spark, sf, "none")
    model = mo.build("hist_gb", cols, iterations=5, depth=3).fit(train)
    return model, train, test, cols


@query("h01_gain_importance")
def h01(spark: SparkSession, sf: str) -> DataFrame:
    model, train, _, cols = _explained(spark, sf)
    return ex.gain_importance(model, cols, train)


@query("h02_permutation_importance")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    model, _, test, cols = _explained(spark, sf)
    return ex.permutation_importance(model, test, cols, repeats=10, metric="f1")


@query("h03_h05_shapley_attribution")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    model, train, test, cols = _explained(spark, sf)
    values = ex.dependence(ex.shapley(model, test, train, cols, permutations=4), test, cols)
    return values.groupBy("variable").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))


@query("h04_local_explanation")
def h04(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions to the score of the test row that the model is surest about."""
    model, train, test, cols = _explained(spark, sf)
    surest = model.transform(test).orderBy(F.desc("score"), "row_id").first()["row_id"]
    values = ex.shapley(model, test.filter(F.col("row_id") == surest), train, cols, permutations=16)
    return ex.local_explanation(values, surest)


@query("h06_pair_interactions")
def h06(spark: SparkSession, sf: str) -> DataFrame:
    model, train, test, cols = _explained(spark, sf)
    return ex.pair_interactions(model, test, train, cols, draws=1).orderBy(F.desc("mean_abs"), "a", "b").limit(15)


# ---- robustness ------------------------------------------------------------------------------

SHIFTABLE = ["f_qty", "f_price", "f_disc"]


@query("b01_b03_recall_under_imitation")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    train, test, cols = prepared(spark, sf, "none")
    model = mo.build("tree", cols, depth=8).fit(train)
    profile = {r["variable"]: r["median"] for r in pr.class_profile(train, cols, "label", 0).collect()}
    positives = rb.with_efforts(test.filter("label = 1"))
    full = rb.overwrite(test.filter("label = 1").withColumn("effort", F.lit(None).cast("double")), profile, cols)
    out = []
    for name, d in (("imitation", rb.imitate(positives, profile, SHIFTABLE)),
                    ("random", rb.jitter(positives, profile, SHIFTABLE)), ("everything", full)):
        out.append(rb.detection_by_effort(model.transform(d)).withColumn("scenario", F.lit(name)))
    return union_all(out)


@query("b05_b07_shift_and_recalibration")
def b05(spark: SparkSession, sf: str) -> DataFrame:
    df = split_table(spark, sf)
    imputer = pp.ColumnImputer(USED, "median", indicators=True).fit(df.filter("split = 'train'").drop("split"))
    imputed = imputer.transform(df.drop("split"))
    cols = [*USED, "missingindicator_f_age"]
    out = []
    for scope, d in (("all", imputed), ("known_age", imputed.filter("missingindicator_f_age = 0"))):
        tagged = written(sp.shift_split(d, "f_age"), "shift")
        train = tagged.filter("part = 'train'").drop("part")
        model = mo.build("tree", cols, depth=6).fit(train)
        shifted = sp.stratified_holdout(tagged.filter("part = 'shifted'").drop("part"), "label", 0.3, name="use",
                                        first="calibrate", rest="measure")
        scored = written(model.transform(shifted).select("row_id", "label", "pred", "score", "use"), "scored")
        cut = mt.best_threshold(scored.filter("use = 'calibrate'")).first()["threshold"]
        measure = scored.filter("use = 'measure'")
        again = measure.withColumn("pred", (F.col("score") >= cut).cast("int"))
        size = train.count()
        for name, p in (("shifted", measure.drop("use")), ("recalibrated", again.drop("use"))):
            out.append(p.withColumns({"scope": F.lit(scope), "scenario": F.lit(name), "threshold": F.lit(
                0.5 if name == "shifted" else float(cut))}))
        for seed in (1, 2, 3, 4, 5):  # control: as many training rows, drawn at random
            drawn = sp.sample_flag(tagged.drop("part"), size, seed)
            pick, rest = drawn.filter("drawn").drop("drawn"), drawn.filter("NOT drawn").drop("drawn")
            control = ev.holdout(pick, rest, mo.build("tree", cols, depth=6))
            out.append(control.withColumns({
                "scope": F.lit(scope), "scenario": F.lit(f"random_{seed}"), "threshold": F.lit(0.5)}))
    return mt.binary_metrics(union_all(out), by=["scope", "scenario", "threshold"])
