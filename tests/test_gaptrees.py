"""Trees on gaps: splits against brute force, views, driver and table alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import gaptrees
from gapweave.operators.clean import Panel
from gapweave.operators.gaptrees import Settings
from gapweave.operators.lattice import Lattice, closed_counts, closed_patterns, lattice_build, superset_sums

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.5 * (x[:, 1] > 0.6) + 0.2 * rng.standard_normal(600)) > 0.8).astype(float)
    gaps = rng.random(x.shape) < 0.25
    gaps[:, 1] |= (y == 1) & (rng.random(600) < 0.5)  # a gap in b speaks for y
    return np.where(gaps, np.nan, x), y


@pytest.fixture(scope="module")
def df(spark, data):
    x, y = data
    rows = [(i, float(t), *[None if np.isnan(v) else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, (600, None, 0.5, 0.5, 0.5)], "row_id long, y double, a double, b double, c double").repartition(5)


def brute_root(x, y, columns, bins, ridge=1.0):
    """Best first split over all edges and both directions."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def score(m):
        return g[m].sum() ** 2 / (h[m].sum() + ridge)

    best = (0.0, None)
    for k in columns:
        lo, hi = np.nanmin(x[:, k]), np.nanmax(x[:, k])
        gap = np.isnan(x[:, k])
        for s in range(bins):
            low = ~gap if s == bins - 1 else x[:, k] <= lo + (hi - lo) * (s + 1) / bins
            for left in (low | gap, low):
                if left.any() and not left.all():
                    gain = round(score(left) + score(~left) - score(np.ones(len(y), bool)), 9)
                    if gain > best[0]:
                        best = (gain, (k, s, left is not low))
    return best


@pytest.mark.parametrize("bins", [4, 16])
def test_first_split(df, data, bins):
    views = [["a"], ["b"], ["c"], NAMES, []]
    model = gaptrees.fit(df, NAMES, "y", views, Settings(rounds=1, depth=1, bins=bins))
    for view, seen in enumerate(views):
        gain, column, at, left, a, b = model.gains[0][view, 0]
        want, where = brute_root(*data, [NAMES.index(s) for s in seen], bins)
        assert gain == pytest.approx(want, abs=1e-8)
        assert a[0] + b[0] == 600  # every row is used in every view
        if where:
            assert (column, at) == where[:2]
        else:
            assert column == -1


@pytest.mark.parametrize("by_rank", [False, True])
def test_driver_and_table_grow_the_same_trees(df, by_rank):
    settings = Settings(rounds=3, depth=3, bins=16, by_rank=by_rank)
    views = [NAMES, ["a", "c"]]
    near, far = (gaptrees.fit(df, NAMES, "y", views, settings, held) for held in (gaptrees.HELD, 0))
    assert len(near.trees) == len(far.trees) == 3
    for one, two in zip(near.trees, far.trees, strict=True):
        assert (one.column == two.column).all() and (one.split == two.split).all() and (one.gap_left == two.gap_left).all()
        np.testing.assert_allclose(one.value, two.value, atol=1e-9)


def test_views_ignore_what_they_do_not_see(spark, df):
    model = gaptrees.fit(df, NAMES, "y", [["a"], NAMES], Settings(rounds=5, depth=3))
    noise = df.withColumn("b", F.rand(1)).withColumn("c", F.lit(None).cast("double"))
    one, two = (d.orderBy("row_id").select(model.predict()[0].alias("p"), model.predict()[1].alias("q")).toPandas() for d in (df, noise))
    assert (one.p == two.p).all() and not (one.q == two.q).all()
    again = gaptrees.fit(noise, NAMES, "y", [["a"]], Settings(rounds=5, depth=3))
    assert (again.trees[-1].column[0] == model.trees[-1].column[0]).all()


def test_learns_from_gaps(df, data):
    def right(rows):
        model = gaptrees.fit(rows.filter("row_id % 2 = 0"), NAMES, "y", [NAMES, []], Settings(rounds=30, depth=2, rate=0.1))
        out = rows.filter("y IS NOT NULL AND row_id % 2 = 1").select("y", model.predict().alias("p")).toPandas()
        p = np.array(out.p.tolist())
        return ((p[:, 0] > 0.5) == (out.y == 1)).mean(), max(out.y.mean(), 1 - out.y.mean())

    aware, most = right(df)
    filled, _ = right(df.fillna({n: float(np.nanmean(data[0][:, k])) for k, n in enumerate(NAMES)}))
    assert aware > filled + 0.02 and aware > most + 0.1  # held-out rows; a gap in b tells more than its mean


def test_a_view_of_nothing_knows_the_share(df, data):
    model = gaptrees.fit(df, NAMES, "y", [NAMES, []], Settings(rounds=3))
    p = np.array(df.filter("y IS NOT NULL").select(model.predict().alias("p")).toPandas().p.tolist())
    assert np.allclose(p[:, 1], data[1].mean())


def test_squared_loss_and_edges(spark, df):
    model = gaptrees.fit(df.withColumn("t", F.col("a") * 3), ["a", "c"], "t", [["a", "c"]], Settings(loss="squared", rounds=40))
    out = df.filter("a IS NOT NULL").select("a", model.predict()[0].alias("p")).toPandas()
    assert np.abs(out.p - 3 * out.a).mean() < 0.2
    none = gaptrees.fit(df.limit(0), NAMES, "y", [NAMES])
    assert none.trees == [] and df.select(none.predict()[0].alias("p")).filter("p <> 0.5").count() == 0
    empty = gaptrees.fit(df.withColumn("b", F.lit(None).cast("double")), NAMES, "y", [["b"]], Settings(rounds=2))
    assert (empty.trees[0].column == -1).all()
    with pytest.raises(ValueError):
        gaptrees.fit(df, NAMES, "y", [NAMES], Settings(bins=400))


def test_masked_lattice(df):
    lat = Lattice([Panel("B", ["b"]), Panel("C", ["c"])], ["a"], "y").fit_masked(df, Settings(rounds=5, depth=2))
    assert sorted(lat.counts) == [0, 1, 2, 3] and set(lat.counts.values()) == {600}
    out = {r["row_id"]: r for r in lat.average(df).collect()}
    assert len(out) == df.count()  # rows without the base feature too
    each = {}
    for r in lat.predict_nodes(df).collect():
        each.setdefault(r["row_id"], []).append(r["p"])
    for i, r in out.items():
        assert r["n_nodes"] == len(each[i]) and r["p"] == pytest.approx(np.mean(each[i]))
    assert lat.route_only(df).count() == df.count()


def test_linear_lattice(df, data):
    x, y = data
    lat = Lattice([Panel(n, [n]) for n in NAMES], [], "y").fit_linear(df)
    assert lat.linear[0] == ({}, 0.5)
    for node in range(1, 8):
        cols = [k for k in range(3) if node >> k & 1]
        rows = ~np.isnan(x[:, cols]).any(axis=1)
        assert lat.counts[node] == rows.sum()
        a, t = x[rows][:, cols], y[rows]
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(len(cols)), (a - a.mean(0)).T @ (t - t.mean()))
        weights, intercept = lat.linear[node]
        assert [weights[NAMES[k]] for k in cols] == pytest.approx(w.tolist()) and intercept == pytest.approx(t.mean() - a.mean(0) @ w)
    assert lat.average(df).count() == lat.route_only(df).count() == df.count()
    own = {r["row_id"]: r["node_mask"] for r in lat.route_only(df).collect()}
    assert all(own[i] == sum(1 << k for k in range(3) if not np.isnan(x[i, k])) for i in range(600))


def test_superset_sums(spark):
    import random

    random.seed(1)
    masks = [(random.choice([1, 5, 12, 31, 16, 0]), random.randint(1, 9)) for _ in range(40)]
    got = {r["node_mask"]: r["n"] for r in superset_sums(spark.createDataFrame(masks, "mask long, n long"), 5, ["n"]).collect()}
    seen = {m & k for m, _ in masks for k in range(32)}
    assert got == {k: sum(n for m, n in masks if m & k == k) for k in seen}


def test_closed_nodes_of_many_panels(spark):
    import random

    random.seed(3)
    base = [sum(1 << k for k in random.sample(range(40), 30)) for _ in range(5)]
    masks = [random.choice(base) & ~sum(1 << k for k in random.sample(range(40), 2)) for _ in range(1000)]
    counts = spark.createDataFrame([(m, 1) for m in masks], "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n_samples"))
    some = counts.orderBy("mask").limit(12)
    given = [r["mask"] for r in some.collect()]
    want = {0, *given}
    while (more := want | {a & b for a in want for b in given}) != want:
        want = more
    got = closed_counts(closed_patterns(some), counts).collect()
    assert {r["node_mask"] for r in got} == want
    assert all(r["n_samples"] == sum(m & r["node_mask"] == r["node_mask"] for m in masks) and r["level"] == bin(r["node_mask"]).count("1") for r in got)
    panels = [Panel(f"p{k}", [f"f{k}"]) for k in range(40)]
    assert lattice_build(spark, panels, [], some).count() == len(want)
    with pytest.raises(ValueError):
        lattice_build(spark, panels, [])
    assert [r["node_mask"] for r in closed_patterns(some.limit(0)).collect()] == [0]
