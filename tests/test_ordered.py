"""Two-level positions equal plain windows, also for hot groups and ties."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapweave.functions.draw import draw, draw_fast
from gapweave.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).withColumn("y", F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))))
    return df.withColumn("u", draw("id", "t", 1))


def test_rank_by_draw(rows):
    got = ordered.rank_by_draw(rows, "u", "id", ["y"])
    want = rows.withColumn("rn", F.row_number().over(W.partitionBy("y").orderBy("u", "id")))
    want = want.withColumn("group_size", F.count("id").over(W.partitionBy("y")))
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert got.count() == 3000


def test_rank_without_group(rows):
    got = {r["id"]: r["rn"] for r in ordered.rank_by_draw(rows, "u", "id").collect()}
    order = sorted((r["u"], r["id"]) for r in rows.collect())
    assert all(got[i] == n + 1 for n, (_, i) in enumerate(order))


def test_rank_does_not_depend_on_partitioning(rows):
    a = {tuple(r) for r in ordered.rank_by_draw(rows.repartition(1), "u", "id", ["y"], buckets=3).collect()}
    b = {tuple(r) for r in ordered.rank_by_draw(rows.repartition(13), "u", "id", ["y"], buckets=50).collect()}
    assert a == b


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(1, None, 0.3), (2, None, 0.1), (3, "a", 0.2)], "id long, y string, u double")
    got = {r["id"]: r["rn"] for r in ordered.rank_by_draw(df, "u", "id", ["y"]).collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def test_ordinal(spark, rows):
    got = {r["id"]: r["rn"] for r in ordered.ordinal(rows, ["y", F.desc("id")]).collect()}
    order = sorted(((r["y"], -r["id"]) for r in rows.collect()))
    assert all(got[-i] == n + 1 for n, (_, i) in enumerate(order))


def test_cumulative(spark):
    rng = random.Random(1)
    vals = sorted({round(rng.gauss(0, 1), 3) for _ in range(500)})
    rows = [(g, v, rng.randint(0, 5)) for g in ("a", "b") for v in vals]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for down in (False, True):
        got = {(r["g"], r["v"]): r["n_before"] for r in ordered.cumulative(df, ["g"], "v", ["n"], down).collect()}
        for g in ("a", "b"):
            run = 0
            for v in reversed(vals) if down else vals:
                assert got[(g, v)] == run
                run += next(n for gg, vv, n in rows if gg == g and vv == v)


@pytest.mark.parametrize("final", [50_000, 2_000, 10])
def test_kth_values(spark, monkeypatch, final):
    monkeypatch.setattr(ordered, "_FINAL_ROWS", final)
    rng = random.Random(2)
    data = [(float(rng.choice([0, 0, 0, rng.randint(1, 400)])), rng.gauss(0, 1)) for _ in range(4000)]
    df = spark.createDataFrame(data, "a double, b double")
    ranks = [1, 7, 1000, 2000, 2999, 4000]
    got = ordered.kth_values(df, {"a": ranks, "b": ranks})
    for j, c in enumerate("ab"):
        order = sorted(r[j] for r in data)
        assert got[c] == [order[k - 1] for k in ranks]


def test_draws_are_uniform_and_stable(spark):
    df = spark.range(20000)
    for fn in (draw, draw_fast):
        s = df.agg(F.avg(fn("id", "x", 3)), F.min(fn("id", "x", 3)), F.max(fn("id", "x", 3))).first()
        assert abs(s[0] - 0.5) < 4 * (1 / 12 / 20000) ** 0.5
        assert 0 <= s[1] and s[2] < 1
    a = {tuple(r) for r in df.repartition(1).select("id", draw("id", "x", 3)).collect()}
    assert a == {tuple(r) for r in df.repartition(13).select("id", draw("id", "x", 3)).collect()}
