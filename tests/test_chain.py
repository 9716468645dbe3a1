"""Tree chains: replay, writes, convergence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import gaptrees, impute

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.random((500, 1)) @ np.ones((1, 3)) + 0.05 * rng.standard_normal((500, 3))
    x[:, 2] = x[:, 2] ** 2
    whole = x.copy()
    x[rng.random(x.shape) < 0.2] = np.nan
    return x, whole


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data[0])]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double").repartition(4)


def filled(model, df):
    return np.array([list(r)[1:] for r in sorted(model.transform(df).collect())])


@pytest.mark.parametrize("forest", [False, True])
def test_fills_gaps_only_and_well(df, data, forest):
    x, whole = data
    model = impute.IterativeTreesImputer(NAMES, depth=3 + forest, trees=30, rounds=3, forest=forest).fit(df)
    out, gaps = filled(model, df), np.isnan(x)
    assert (out[~gaps] == x[~gaps]).all() and not np.isnan(out).any()
    mean = np.where(gaps, np.nanmean(x, axis=0), x)
    rows = gaps & (gaps.sum(axis=1) < 3)[:, None]
    assert np.abs(out - whole)[rows].mean() < 0.4 * np.abs(mean - whole)[rows].mean()


def test_each_step_is_the_model_of_the_rows_as_they_were(df, data):
    x, _ = data
    model = impute.IterativeTreesImputer(NAMES, depth=2, trees=5, rounds=2, tolerance=0.0).fit(df)
    assert len(model.steps) == 6
    gaps = np.isnan(x)
    now = np.where(gaps, np.nanmean(x, axis=0), x)
    for j, trees in model.steps:
        others = [k for k in range(3) if k != j]
        assert trees.rows == (~gaps[:, j]).sum() and trees.base == pytest.approx(x[~gaps[:, j], j].mean())
        now[gaps[:, j], j] = trees.margins(trees.bins(now[gaps[:, j]][:, others]))[:, 0]
    np.testing.assert_allclose(filled(model, df), now)


def test_nothing_is_written(df, monkeypatch):
    writes = []
    monkeypatch.setattr(gaptrees, "cut", lambda d: writes.append(1) or d)
    impute.IterativeTreesImputer(NAMES, depth=2, trees=3, rounds=2).fit(df)
    assert writes == []


@pytest.mark.parametrize("forest", [False, True])
def test_table_and_driver_agree(df, monkeypatch, forest):
    near = impute.IterativeTreesImputer(["a", "b"], depth=2, trees=3, rounds=1, forest=forest).fit(df)
    monkeypatch.setattr(gaptrees.fit, "__defaults__", (None, 0, None, None))
    far = impute.IterativeTreesImputer(["a", "b"], depth=2, trees=3, rounds=1, forest=forest).fit(df)
    got = [np.array([[r["a"], r["b"]] for r in m.transform(df).orderBy("row_id").collect()]) for m in (near, far)]
    np.testing.assert_allclose(*got, atol=1e-9)


def test_edges(df):
    odd = df.withColumn("b", F.lit(None).cast("double"))
    model = impute.IterativeTreesImputer(NAMES, trees=2, rounds=1).fit(odd)
    row = model.transform(odd).agg(F.count("a"), F.count("b"), F.count("c")).first()
    assert tuple(row) == (500, 0, 500)
    assert impute.IterativeTreesImputer(NAMES).fit(df.limit(0)).steps == []
    assert impute.IterativeTreesImputer(["a"], rounds=1).fit(df).transform(df).filter("a IS NULL").count() == 0


def test_bootstrap_counts():
    bins = np.random.default_rng(0).integers(0, 200, (40_000, 2)).astype(np.uint8)
    u = gaptrees.draws(bins, 3, 1)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003
    assert abs(np.corrcoef(u, gaptrees.draws(bins, 4, 1))[0, 1]) < 0.02
    for mean in (1.0, 7.0, 49.0, 400.0):
        k = gaptrees.poisson(u, np.full(len(u), mean))
        assert abs(k.mean() - mean) < 0.03 * mean and abs(k.var() - mean) < 0.08 * mean and (k == np.round(k)).all()


def test_trees_of_a_forest_differ(df):
    settings, views = gaptrees.forest(8, 3)
    model = gaptrees.fit(df, ["a", "b"], "c", [["a", "b"]] * views, settings)
    assert len(model.trees) == 1 and len({model.trees[0].value[v].tobytes() for v in range(views)}) == views


def test_rows_are_filled_by_the_worker_that_bins_them(df, monkeypatch):
    plans, binned = [], gaptrees.binned
    monkeypatch.setattr(gaptrees, "binned", lambda d, *a: plans.append(binned(d, *a)) or plans[-1])
    impute.IterativeTreesImputer(NAMES, depth=2, trees=3, rounds=2).fit(df)
    for plan in plans:
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("MapInArrow") == 1 and "ArrowEvalPython" not in text
