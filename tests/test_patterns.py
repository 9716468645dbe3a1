"""Sums of products by pattern against regressions on the rows."""

import numpy as np
import pytest

from gapweave.operators import impute, patterns

NAMES = ["a", "b", "c", "d", "e"]


def rows(seed, n=300, rate=0.3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 2))
    x = np.stack([base[:, 0], base[:, 0] + 0.3 * base[:, 1], base[:, 1] ** 2, 5 + rng.standard_normal(n), base.sum(axis=1)], axis=1)
    x[rng.random(x.shape) < rate] = np.nan
    return x


def frame(spark, x):
    values = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(values)], "row_id long, " + ", ".join(f"{n} double" for n in NAMES)).repartition(5)


def by_rows(x, rounds, strength):
    """The same regressions, step by step on the filled rows; columns in order of their gaps."""
    gaps = np.isnan(x)
    m = np.where(gaps, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        for j in sorted(np.flatnonzero(gaps.any(axis=0)), key=lambda j: (gaps[:, j].sum(), j)):
            others, seen = [i for i in range(x.shape[1]) if i != j], ~gaps[:, j]
            p, t = m[seen][:, others], m[seen, j]
            w = np.linalg.solve((p - p.mean(0)).T @ (p - p.mean(0)) + strength * np.eye(len(others)), (p - p.mean(0)).T @ (t - t.mean()))
            m[gaps[:, j], j] = m[gaps[:, j]][:, others] @ w + t.mean() - p.mean(0) @ w
    return m


@pytest.mark.parametrize("held", [patterns.HELD, 0])
def test_rounds_on_patterns_equal_rounds_on_rows(spark, monkeypatch, held):
    monkeypatch.setattr(patterns.PatternTable.__init__, "__defaults__", (held,))
    x = rows(1)
    df = frame(spark, x)
    model = impute.IterativeRidgeImputer(NAMES, rounds=4, tolerance=0.0, bayes=False, strength=0.5).fit(df)
    got = np.array([list(r)[1:] for r in sorted(model.transform(df).collect())])
    assert len(model.steps) == 20
    np.testing.assert_allclose(got, by_rows(x, 4, 0.5), rtol=1e-8, atol=1e-8)


def test_one_scan_of_the_rows_for_any_rounds(spark):
    scans = spark.sparkContext.accumulator(0)
    x = frame(spark, rows(2)).cache()
    x.count()

    def noted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    counted = x.mapInArrow(noted, x.schema)
    impute.IterativeRidgeImputer(NAMES, rounds=8, tolerance=0.0).fit(counted)
    assert scans.value == 2 * 300  # means and counts, then the sums
    x.unpersist()


def test_stops_where_rows_settle(spark):
    x = rows(3, rate=0.1)
    df = frame(spark, x)
    loose = impute.IterativeRidgeImputer(NAMES, rounds=50, tolerance=1e-2, bayes=False).fit(df)
    gaps, limit = np.isnan(x), 1e-2 * np.nanmax(np.abs(x))
    moved = [np.abs(by_rows(x, k, 1.0) - by_rows(x, k - 1, 1.0)).max() for k in range(2, loose.rounds + 1)]
    assert gaps.any() and loose.rounds < 50
    assert moved[-1] < limit and all(m >= limit for m in moved[:-1])


def test_bounds_hold(spark):
    x = rows(4)
    df = frame(spark, x)
    centre = dict(zip(NAMES, np.nanmean(x, axis=0), strict=True))
    table = patterns.PatternTable(df, NAMES, centre)
    step = patterns.LinearStep(1, np.array([0.5, 0.0, 0.1, 0.0, -0.2]), 0.3)
    table.apply(step)
    low, high = table.move(0)
    filled = np.where(np.isnan(x), 0.0, x - np.nanmean(x, axis=0))
    change = np.abs(filled @ step.coef + step.intercept)[np.isnan(x[:, 1])].max()
    assert low <= change + 1e-12 and change <= high + 1e-12


def test_many_patterns_and_odd_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 5))
    x[rng.random(x.shape) < 0.5] = np.nan
    x[:, 2] = np.nan
    df = frame(spark, x)
    model = impute.IterativeRidgeImputer(NAMES, rounds=3).fit(df)
    out = model.transform(df)
    got = out.selectExpr(*[f"count({n}) AS {n}" for n in NAMES]).first()
    assert tuple(got) == (200, 200, 0, 200, 200)
    assert impute.IterativeRidgeImputer(NAMES).fit(df.limit(0)).steps == []
    assert impute.IterativeRidgeImputer(["a"]).fit(df).transform(df.limit(3)).count() == 3
