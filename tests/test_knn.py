"""Neighbour join against brute force, in both physical forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.operators import impute, knn


def brute(q, v, k, nan_aware=False):
    out = {}
    for qi, *qx in q:
        scored = []
        for vi, *vx in v:
            pairs = [(a, b) for a, b in zip(qx, vx) if a is not None and b is not None]
            if nan_aware:
                if not pairs:
                    continue
                d = np.sqrt(sum((a - b) ** 2 for a, b in pairs) * len(qx) / len(pairs))
            else:
                d = np.sqrt(sum((a - b) ** 2 for a, b in pairs))
            scored.append((round(float(d), 9), vi))
        out[qi] = [(vi, d) for d, vi in sorted(scored)[:k]]
    return out


def collect(df):
    got = {}
    for r in df.orderBy("row_id", "rank").collect():
        got.setdefault(r["row_id"], []).append((r["val_id"], r["dist"]))
    return got


def close(got, want):
    assert set(got) == {k for k, v in want.items() if v}
    for key, pairs in got.items():
        assert [a for a, _ in pairs] == [a for a, _ in want[key]]
        assert [b for _, b in pairs] == pytest.approx([b for _, b in want[key]], abs=2e-9)


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double")


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    v = [(i, rng.random(), round(rng.random(), 1), rng.gauss(0, 1)) for i in range(400)]
    v += [(i, 0.5, 0.5, 0.0) for i in range(400, 600)]  # a third of the rows are copies of one vector
    q = [(i, rng.random(), rng.random(), rng.gauss(0, 1)) for i in range(80)] + [(100 + i, 0.5, 0.5, 0.0) for i in range(20)]
    return q, v


@pytest.mark.parametrize("cells", [knn.BROADCAST_CELLS, 0])
@pytest.mark.parametrize("k", [1, 5, 700])
def test_forms(spark, monkeypatch, data, cells, k):
    monkeypatch.setattr(knn, "CHUNK_ROWS", 37)
    q, v = data
    if k == 700:
        q, v = q[:10], v[:50]  # fewer reference rows than k
    got = knn.knn_join(table(spark, q), table(spark, v), ["a", "b", "c"], k, max_cells=cells, pivots=16)
    close(collect(got), brute(q, v, k))


@pytest.mark.parametrize("cells", [knn.BROADCAST_CELLS, 0])
def test_gaps(spark, monkeypatch, cells):
    monkeypatch.setattr(knn, "CHUNK_ROWS", 23)
    rng = random.Random(4)

    def row(i):
        return (i, *[rng.random() if rng.random() > 0.4 else None for _ in range(3)])

    q, v = [row(i) for i in range(60)], [row(i) for i in range(200)]
    got = knn.knn_join(table(spark, q), table(spark, v), ["a", "b", "c"], 4, nan_aware=True, max_cells=cells)
    close(collect(got), brute(q, v, 4, True))


def test_carry_and_payload(spark, data):
    q, v = data
    qs = table(spark, q).withColumn("p", F.col("a") * 2).withColumn("tag", F.concat(F.lit("t"), F.col("row_id").cast("string")))
    vs = table(spark, v).withColumn("e", F.col("row_id") * 1.5)
    got = knn.knn_join(qs, vs, ["a", "b", "c"], 3, carry=["p", "tag"], payload=["e"]).collect()
    assert all(r["e"] == r["val_id"] * 1.5 and r["tag"] == f"t{r['row_id']}" for r in got)
    assert len(got) == 3 * len(q)


@pytest.mark.parametrize("weighted", [False, True])
def test_knn_imputer(spark, weighted):
    rng = random.Random(6)
    train = [(i, *[round(rng.random(), 2) if rng.random() > 0.3 else None for _ in range(3)]) for i in range(120)]
    test = [(1000 + i, *[round(rng.random(), 2) if rng.random() > 0.3 else None for _ in range(3)]) for i in range(40)] + [(2000, None, None, None), (2001, *train[0][1:])]
    want = {}
    for ti, *tx in test:
        filled = list(tx)
        for j in range(3):
            if tx[j] is not None:
                continue
            donors = [r for r in train if r[1 + j] is not None]
            near = brute([(ti, *tx)], donors, 5, True)[ti]
            value = {r[0]: r[1 + j] for r in donors}
            if not near:
                have = [r[1 + j] for r in train if r[1 + j] is not None]
                filled[j] = sum(have) / len(have)
            elif not weighted:
                filled[j] = sum(value[i] for i, _ in near) / len(near)
            elif any(d == 0 for _, d in near):
                hit = [value[i] for i, d in near if d == 0]
                filled[j] = sum(hit) / len(hit)
            else:
                filled[j] = sum(value[i] / d for i, d in near) / sum(1 / d for _, d in near)
        want[ti] = filled
    model = impute.KnnImputer(["a", "b", "c"], "row_id", 5, weighted).fit(table(spark, train))
    got = {r["row_id"]: [r["a"], r["b"], r["c"]] for r in model.transform(table(spark, test), "row_id").collect()}
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-7)


def test_least_mean_gap_over_all_shared_sets():
    from itertools import combinations

    rng = np.random.default_rng(0)
    gap = rng.random((6, 5, 4))
    always, sometimes = rng.random((6, 5, 4)) < 0.3, rng.random((6, 5, 4)) < 0.5
    sometimes &= ~always
    got = knn.least_mean_gap(gap, always, sometimes)
    for i in range(6):
        for j in range(5):
            sure, perhaps = np.flatnonzero(always[i, j]), np.flatnonzero(sometimes[i, j])
            sets = [[*sure, *extra] for m in range(len(perhaps) + 1) for extra in combinations(perhaps, m)]
            means = [gap[i, j, s].mean() for s in sets if len(s)]
            assert got[i, j] == pytest.approx(min(means)) if means else np.isinf(got[i, j])


@pytest.mark.parametrize("pivots", [1, 7, 60])
@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e6, 1e9)])
def test_gap_cells(spark, monkeypatch, pivots, scale, shift):
    monkeypatch.setattr(knn, "CHUNK_ROWS", 31)
    rng = random.Random(pivots)

    def rows(n):
        out = []
        for i in range(n):
            centre = rng.choice([0.0, 10.0, 20.0]) * scale + shift
            out.append((i, *[None if rng.random() < 0.35 else centre + scale * rng.gauss(0, 1) for _ in range(3)]))
        return out

    q, v = rows(60), rows(300)
    got = collect(knn.knn_join(table(spark, q), table(spark, v), ["a", "b", "c"], 4, nan_aware=True, max_cells=0, pivots=pivots))
    want = brute(q, v, 4, True)
    assert {k: [a for a, _ in x] for k, x in got.items()} == {k: [a for a, _ in x] for k, x in want.items() if x}


def test_gap_cells_rule_out_most_copies(spark):
    rng = random.Random(8)

    def rows(n):
        return [(i, *[None if rng.random() < 0.2 else 100.0 * (i % 12) + rng.random() for _ in range(3)]) for i in range(n)]

    shape = knn._Shape(3, 0, [], 3, True)
    q, v = (table(spark, rows(n)).select(F.col("row_id").alias(name), *knn._numbers(["a", "b", "c"], "_x")) for n, name in ((100, "_q"), (1200, "_v")))
    home, visits = knn._assign_gap_cells(q, v, shape, 150)
    cells = home.select("_cell").distinct().count()
    assert visits.count() < 0.35 * 100 * cells


def _planes(rng, n):
    """Rows on planes, as constants in place of gaps make them, with copies and steps in one column."""
    x = rng.random((n, 3))
    x[:, 1] = np.round(x[:, 1], 1)
    x = np.where(rng.random(x.shape) < 0.3, 0.5, x)
    return np.concatenate((x, x[: n // 4]))


def _held(x, k, nan_aware=False):
    import pandas as pd

    shape = knn._Shape(x.shape[1], 0, [], k, nan_aware)
    return knn._Reference(pd.DataFrame(x, columns=shape.xs).assign(_v=np.arange(len(x))), shape)


def test_boxes_look_at_few_points():
    rng = np.random.default_rng(5)
    for n, most in ((4_000, 0.06), (16_000, 0.02)):
        x, q = _planes(rng, n), _planes(rng, 160)
        ref = _held(x, 7)
        got, want = ref.nearest(q), knn._best(knn._squares(q, x, False), 7)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
        boxes = ref.made["all"][1]
        limit = boxes._bound(q, 1.0)
        assert np.isfinite(limit).all()
        assert sum(len(pairs[0]) for _, pairs in boxes._within(q, limit)) < most * len(q) * len(x)


@pytest.mark.parametrize("width,k", [(2, 1), (3, 40), (12, 5), (30, 700)])
def test_search_in_a_task(width, k):
    rng = np.random.default_rng(width)
    x, q = (np.round(rng.normal(size=(n, width)), 1) for n in (600, 90))
    x[300:] = x[:300]
    got, want = _held(x, k).nearest(np.concatenate((q, x[:20]))), knn._best(knn._squares(np.concatenate((q, x[:20])), x, False), k)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    if width <= 3:
        x, q = (np.where(rng.random(a.shape) < 0.3, np.nan, a) for a in (x, q))
        got, want = _held(x, k, True).nearest_shared(q), knn._best(knn._squares(q, x, True), k)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_rows_without_a_number_are_no_neighbours():
    x = np.array([[0.0, np.nan], [1.0, 1.0], [np.inf, 1.0], [2.0, 2.0]])
    rows, pos, _ = _held(x, 2).nearest(np.array([[0.0, 0.0], [np.nan, 0.0]]))
    assert rows.tolist() == [0, 0] and pos.tolist() == [1, 3]


def test_many_patterns_use_the_gap_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "MAX_PATTERNS", 2)
    rng = random.Random(9)
    q, v = ([(i, *[None if rng.random() < 0.35 else rng.random() for _ in range(3)]) for i in range(n)] for n in (40, 150))
    got = knn.knn_join(table(spark, q), table(spark, v), ["a", "b", "c"], 4, nan_aware=True, max_cells=0, pivots=5)
    close(collect(got), brute(q, v, 4, True))


@pytest.mark.parametrize("offset", [0.0, 1e7, 1e200])
def test_products_tile_by_tile(monkeypatch, offset):
    monkeypatch.setattr(knn, "TILE", (7, 16))
    rng = np.random.default_rng(4)
    v = rng.integers(0, 3, (90, 10)) + offset  # many equal distances
    x = np.concatenate((rng.integers(0, 3, (20, 10)) + offset, v[:5]))
    rows, pos, dist = knn._best(knn._squares(x, v, False), 4)
    found = knn._by_products(x, v, 4, 1.0)
    assert all((a == b).all() for a, b in zip(found, (rows, pos, dist), strict=True))
    far = dist.reshape(25, 4)[:, 2]
    got = set(zip(*(a.tolist() for a in knn._by_products(x, v, 4, 1.0, far)), strict=True))
    near = dist <= far[rows]
    assert got >= set(zip(rows[near].tolist(), pos[near].tolist(), dist[near].tolist(), strict=True))


def test_wide_queries_are_sent_to_few_cells(spark, monkeypatch):
    sent, further = [], knn._further
    monkeypatch.setattr(knn, "_further", lambda *a: sent.append(further(*a)) or sent[-1])
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 10))
    names = [f"x{i}" for i in range(10)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{n} double" for n in names))
    got = collect(knn.knn_join(df.limit(40), df, names, 3, max_cells=0))
    close(got, brute([(i, *x[i]) for i in got], [(i, *r) for i, r in enumerate(x)], 3))
    assert len(got) == 40 and sent[0].count() <= 40 * 8  # 54 cells before
