"""Invariants of imputers, pools, lattice, boosting and the experiment runner."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from gapweave.functions.draw import draw
from gapweave.operators import impute, models
from gapweave.operators.clean import Panel
from gapweave.operators.inject import hide_mcar
from gapweave.operators.lattice import Lattice
from gapweave.plans.experiment import Settings, run_grid, run_one
from gapweave.sources.specs import TableSpec

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def full(spark):
    u = [draw("row_id", s, 5) for s in "xyz"]
    df = spark.range(400).withColumnRenamed("id", "row_id")
    df = df.select("row_id", u[0].alias("a"), (u[0] * 0.8 + u[1] * 0.2).alias("b"), (1 - u[0] + 0.1 * u[2]).alias("c"))
    return df.withColumn("y", (F.col("a") > 0.5).cast("double")).persist()


@pytest.fixture(scope="module")
def gaps(full):
    hidden = hide_mcar(FEATS, "row_id", 0.25, 3)
    return full.select("row_id", "y", *[F.when(~hidden[x], F.col(x)).alias(x) for x in FEATS]).persist()


IMPUTERS = {
    "mean": lambda: impute.MeanImputer(FEATS),
    "mode": lambda: impute.ModeImputer(FEATS),
    "zero": lambda: impute.ConstantImputer(FEATS),
    "ridge": lambda: impute.IterativeRidgeImputer(FEATS, rounds=5),
    "trees": lambda: impute.IterativeModelImputer(FEATS, impute.boosted_trees(2, 2), rounds=1),
    "forest": lambda: impute.IterativeModelImputer(FEATS, impute.forest(3, 4), rounds=2),
}


@pytest.mark.parametrize("name", sorted(IMPUTERS))
def test_imputers_fill_gaps_only(gaps, name):
    out = IMPUTERS[name]().fit(gaps).transform(gaps)
    both = out.select("row_id", *[F.col(x).alias(f"f_{x}") for x in FEATS]).join(gaps, "row_id").persist()
    assert both.count() == 400
    assert both.filter(" or ".join(f"f_{x} is null" for x in FEATS)).count() == 0
    assert both.filter(" or ".join(f"({x} is not null and abs({x} - f_{x}) > 1e-12)" for x in FEATS)).count() == 0


def test_ridge_beats_means(full, gaps):
    def rmse(filled):
        j = filled.select("row_id", *[F.col(x).alias(f"f_{x}") for x in FEATS]).join(full, "row_id")
        return j.agg(F.sqrt(F.avg(sum((F.col(f"f_{x}") - F.col(x)) ** 2 for x in FEATS)))).first()[0]

    mean = rmse(impute.MeanImputer(FEATS).fit(gaps).transform(gaps))
    assert rmse(IMPUTERS["ridge"]().fit(gaps).transform(gaps)) < 0.7 * mean


def test_ridge_from_sums_equals_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    x[:, 2] = 1.5 * x[:, 0] - 0.5 * x[:, 1] + 0.7 + rng.normal(size=300) * 0.01
    z = np.hstack([np.ones((300, 1)), x])
    for strength in (None, 1e-9):
        coef, b = impute._solve(z.T @ z, [0, 1], 2, strength)
        assert coef == pytest.approx([1.5, -0.5, 0.0], abs=0.01)
        assert b == pytest.approx(0.7, abs=0.01)


def test_ridge_is_stable_under_partitioning(gaps):
    a = impute.IterativeRidgeImputer(FEATS, rounds=2).fit(gaps.repartition(1)).transform(gaps)
    b = impute.IterativeRidgeImputer(FEATS, rounds=2).fit(gaps.repartition(7)).transform(gaps)
    r = lambda d: d.select("row_id", *[F.round(x, 8).alias(x) for x in FEATS])
    assert r(a).exceptAll(r(b)).count() == 0


def test_member_and_threshold(gaps):
    m = models.ImputedModel(impute.MeanImputer(FEATS), lambda: LogisticRegression(), FEATS, "y").fit(gaps)
    p = m.predict(gaps)
    assert p.filter("p < 0 or p > 1 or p is null").count() == 0
    assert 0 <= m.tune_threshold(gaps, 1.0) < 1
    assert m.labels(gaps).select("label").distinct().count() == 2


def test_lattice_routes(gaps):
    lat = Lattice([Panel("B", ["b"]), Panel("C", ["c"])], ["a"], "y")
    df = gaps.na.drop(subset=["a"])
    lat.fit(df, lambda: LogisticRegression(regParam=0.01))
    assert sorted(lat.models) == [0, 1, 2, 3]
    out = lat.average(df)
    assert out.count() == df.count()
    assert out.filter("p < 0 or p > 1").count() == 0
    assert lat.route_only(df).count() == df.count()
    full = lat.average_imputed(df, impute.MeanImputer(FEATS).fit(df))
    assert full.select("n_nodes").distinct().collect()[0][0] == 4
    assert lat.stack(df, df, lambda: LogisticRegression()).count() == df.count()
    assert lat.fit_thresholds(df).count() == 4


def test_lattice_without_base_features(gaps):
    lat = Lattice([Panel("B", ["b"])], [], "y").fit(gaps, lambda: LogisticRegression())
    empty = lat.predict_nodes(gaps).filter("node_mask = 0")
    assert empty.filter("p != 0.5").count() == 0 and empty.count() == 400


def test_boosting(full, gaps):
    signed = full.withColumn("y", F.when(F.col("y") == 1, 1).otherwise(-1)).withColumn("y", F.when(F.col("row_id") % 9 == 0, -F.col("y")).otherwise(F.col("y")))
    boost = models.adaboost(FEATS, "y", rounds=3).fit(signed)
    out = boost.predict(signed).join(signed.select("row_id", "y"), "row_id")
    assert out.filter("label = y").count() > 340
    aware = models.StumpBoost(FEATS, "y", rounds=2).fit(signed)
    assert aware.predict(gaps.withColumn("y", F.lit(1))).count() == 400
    with pytest.raises(ValueError):
        models.StumpBoost(FEATS, "y", rounds=4).fit(signed)


def test_boosting_stops_on_a_perfect_stump(full):
    signed = full.withColumn("y", F.when(F.col("y") == 1, 1).otherwise(-1))
    assert models.adaboost(FEATS, "y", rounds=5).fit(signed).models == []


def _pool(features, target, id_col):
    makers = {"forest": lambda: RandomForestClassifier(maxDepth=2, numTrees=3, seed=0)}
    imputers = {"mean": lambda: impute.MeanImputer(features), "knn": lambda: impute.KnnImputer(features, id_col)}
    return models.cross(makers, imputers, features, target, id_col)


def test_experiment(spark, full, tmp_path):
    spec = TableSpec(full, "toy", "y")
    grid = [{"p_miss": 0.1, "mechanism": "MCAR"}]
    out = str(tmp_path / "out")
    run_grid(spec, grid, _pool, out, Settings(folds=3, parallel=1, stack_trees=3), only_folds=[0])
    names = {r["model"] for r in spark.read.parquet(f"{out}/run=0/metrics").select("model").distinct().collect()}
    assert names == {"forest+mean", "forest+knn", "uniform", "stacking", "dew_top_1", "dew_top_3", "dew_top_all"}
    w = spark.read.parquet(f"{out}/run=0/weights").groupBy("row_id", "top_n").agg(F.sum("w").alias("s"))
    assert w.filter("abs(s - 1) > 1e-9").count() == 0
    final = spark.read.option("header", True).csv(f"{out}/final_results")
    assert final.count() == 7 * 3
    evals = spark.read.parquet(f"{out}/run=0/imputation_eval")
    assert {r["model"] for r in evals.collect()} == {"forest+mean", "forest+knn", "mean"}
    assert spark.read.json(f"{out}/params_lookup").count() == 1


def test_regression_experiment(full):
    from pyspark.ml.regression import RandomForestRegressor

    def pool(features, target, id_col):
        make = {"forest": lambda: RandomForestRegressor(maxDepth=2, numTrees=2, seed=0)}
        return models.cross(make, {"mean": lambda: impute.MeanImputer(features)}, features, target, id_col)

    spec = TableSpec(full.drop("y").withColumn("t", F.round("c", 1)).drop("c"), "toy", "t")
    out = run_one(spec, {"p_miss": 0.1}, pool, Settings(folds=3, parallel=1, top_n=[1, 0], stack_trees=3), regression=True, only_folds=[1])
    got = {r["model"]: r["value"] for r in out.metrics.collect()}
    assert set(got) == {"forest+mean", "uniform", "stacking", "dew_top_1", "dew_top_all"}
    assert got["uniform"] == pytest.approx(got["forest+mean"]) == pytest.approx(got["dew_top_1"])


def test_experiment_with_text_features(full):
    rows = full.withColumn("word", F.when(F.col("a") > 0.5, "up").otherwise("down")).withColumn("kind", F.concat(F.lit("k"), (F.col("row_id") % 3).cast("string")))
    out = run_one(TableSpec(rows, "toy", "y"), {"p_miss": 0.2}, _pool, Settings(folds=3, parallel=1, top_n=[1], stack_trees=3, fit_scaling_on="train"), only_folds=[0])
    got = {(r["model"], r["feature"]): r for r in out.imputation.collect()}
    assert {f for _, f in got} == {*FEATS, "word", "kind"}
    assert got["forest+knn", "word"]["roc_auc"] > 0.7 and got["mean", "word"]["roc_auc"] == 0.5
    assert got["mean", "kind"]["roc_auc"] is None and got["mean", "a"]["roc_auc"] is None
    assert got["mean", "a"]["rmse"] < 0.5  # truth and fill are scaled alike


def test_experiment_query_takes_the_whole_study(spark, tmp_path, monkeypatch):
    """All folds, stacking trees and weighted pools of the runner, none left out by the query."""
    from gapweave.plans import load_all, q_models

    spark.range(1, 21).selectExpr("id AS c_custkey", "id * 1.5 AS c_acctbal", "if(id % 2 = 0, 'BUILDING', 'MACHINERY') AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(40).selectExpr("id % 20 + 1 AS o_custkey", "id * 10.0 AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    asked = []

    def run(spec, params, make_pool, settings=None, regression=False, folds=None, only_folds=None):
        asked.append((spec.df.count(), settings or Settings(), folds, only_folds))
        return type("Out", (), {"metrics": spec.df.selectExpr("0 AS fold", "a AS value")})

    monkeypatch.setattr(q_models, "run_one", run)
    load_all()[0]["experiment_run"](spark, str(tmp_path)).collect()
    rows, settings, folds, only = asked[0]
    assert rows == 20 and folds is None and only is None
    assert (settings.folds, settings.stack_trees, settings.top_n, settings.k) == (5, 60, [1, 3, 0], 7)
    assert settings == Settings()


def test_boosting_on_the_table_and_on_the_driver(gaps):
    signed = gaps.withColumn("y", F.when(F.col("y") == 1, 1).otherwise(-1)).withColumn("y", F.when(F.col("row_id") % 9 == 0, -F.col("y")).otherwise(F.col("y")))
    near, far = (models.StumpBoost(FEATS, "y", 3, bins=16, held=held).fit(signed) for held in (1 << 20, 0))
    assert [(s.column, s.split, s.left, s.right) for s in near.models] == [(s.column, s.split, s.left, s.right) for s in far.models]
    assert near.betas == pytest.approx(far.betas) and len(near.betas) == 3
    assert models.StumpBoost(FEATS, "y", 2).fit(signed.limit(0)).models == []
