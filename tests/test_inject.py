"""Rates and laws of the injection mechanisms, samplers and splits."""

import pytest
from pyspark.sql import functions as F

from gapweave.functions.draw import draw
from gapweave.operators import inject, sampling
from gapweave.operators.clean import null_counts

FEATS = ["a", "b", "c", "d"]
N = 6000


@pytest.fixture(scope="module")
def df(spark):
    cols = [draw("row_id", f"v{x}", 9).alias(x) for x in FEATS]
    return spark.range(N).withColumnRenamed("id", "row_id").select("row_id", (F.col("row_id") % 7 == 0).cast("int").alias("y"), *cols).persist()


def rates(inj):
    return {r["feature"]: r["nulls"] / N for r in null_counts(inj.incomplete, FEATS).collect()}


def near(rate, p):
    return abs(rate - p) < 4 * (p * (1 - p) / N) ** 0.5


@pytest.mark.parametrize("p", [0.1, 0.4])
def test_mcar(df, p):
    assert all(near(r, p) for r in rates(inject.inject(df, FEATS, "row_id", p)).values())


def test_unknown_mechanism_is_mcar(df):
    a = inject.inject(df, FEATS, "row_id", 0.2, "MNAR", "nothing").mask
    assert a.exceptAll(inject.inject(df, FEATS, "row_id", 0.2).mask).count() == 0


@pytest.mark.parametrize("p", [0.1, 0.5])
def test_mar_keeps_drivers(df, p):
    got = rates(inject.inject(df, FEATS, "row_id", p, "MAR", p_obs=0.3))
    assert sum(r == 0 for r in got.values()) == 1  # max(int(0.3 * 4), 1)
    assert all(near(r, p) for r in got.values() if r)


def test_mnar_logistic(df):
    assert all(near(r, 0.3) for r in rates(inject.inject(df, FEATS, "row_id", 0.3, "MNAR", "logistic", 0.3)).values())


def test_self_mask_depends_on_the_cell(df):
    inj = inject.Injected(df, FEATS, inject.hide_mnar_self(df, FEATS, "row_id", 0.3, 1, per_column=True), "row_id")
    assert all(near(r, 0.3) for r in rates(inj).values())
    w = inj.with_flags().agg(*[F.abs(F.corr(F.col(x), F.col(f"m_{x}").cast("double"))).alias(x) for x in FEATS]).first()
    assert all(w[x] > 0.1 for x in FEATS)


MECHANISMS = [
    ("MCAR", None, None, None), ("MAR", None, 0.3, None), ("MNAR", "logistic", 0.3, None), ("MNAR", "selfmasked", None, None), ("MNAR", "quantile", 0.5, 0.25),
]


@pytest.mark.parametrize("gaps", [0.0, 0.2, 0.4])
@pytest.mark.parametrize("mechanism,opt,p_obs,q", MECHANISMS)
def test_rates_hold_for_known_cells(df, gaps, mechanism, opt, p_obs, q):
    holed = df.withColumns({x: F.when(draw("row_id", f"gap{x}", 3) >= gaps, F.col(x)) for x in FEATS})
    inj = inject.inject(holed, FEATS, "row_id", 0.2, mechanism, opt, p_obs, q)
    rows = inj.with_flags().agg(*[F.count(x).alias(f"n_{x}") for x in FEATS], *[F.count_if(F.col(f"m_{x}") & F.col(x).isNotNull()).alias(x) for x in FEATS],
                                *[F.count_if(F.col(f"x_{x}").isNotNull()).alias(f"left_{x}") for x in FEATS]).first()
    want = 0.2 if opt != "quantile" else 0.2 * 0.5
    shares, n = [], []
    for x in FEATS:
        assert rows[f"left_{x}"] == rows[f"n_{x}"] - rows[x]  # what is not hidden stays
        if rows[x]:
            shares.append(rows[x] / rows[f"n_{x}"])
            n.append(rows[f"n_{x}"])
    assert len(shares) == {"MAR": 3, "quantile": 2}.get(opt or mechanism, 4)
    if opt == "selfmasked":  # the intercept is fitted on all columns pooled
        assert abs(sum(shares) / 4 - want) < 0.02
    else:
        assert all(abs(r - want) < 4 * (want * (1 - want) / m) ** 0.5 for r, m in zip(shares, n, strict=True))


def test_gaps_are_not_hidden_again(df):
    holed = df.withColumn("b", F.when(F.col("row_id") % 2 == 0, F.col("b")))
    for mechanism, opt, p_obs, q in MECHANISMS[1:]:
        inj = inject.inject(holed, FEATS, "row_id", 0.4, mechanism, opt, p_obs, q).with_flags()
        assert inj.filter("b IS NULL AND m_b AND x_b IS NOT NULL").count() == 0


def test_constant_and_empty_columns(df):
    odd = df.withColumn("c", F.lit(2.0)).withColumn("d", F.lit(None).cast("double"))
    for mechanism, opt, p_obs, q in MECHANISMS:
        row = inject.inject(odd, FEATS, "row_id", 0.3, mechanism, opt, p_obs, q).incomplete.agg(F.count("a"), F.count("c"), F.count("d")).first()
        assert row[0] > N / 2 and row[1] > N / 3 and row[2] == 0


def test_grid_gives_what_each_set_gives(df):
    grid = [{"p_miss": 0.2, "mechanism": m, "opt": o, "p_obs": s, "q": q} for m, o, s, q in MECHANISMS]
    swept = inject.sweep_grid(df, FEATS, "row_id", grid).cache()
    for run, (m, o, s, q) in enumerate(MECHANISMS):
        alone = inject.inject(df, FEATS, "row_id", 0.2, m, o, s, q, single_precision=False).incomplete.select("row_id", *FEATS)
        assert swept.filter(F.col("run") == run).select("row_id", *FEATS).exceptAll(alone).count() == 0
    assert swept.count() == N * len(grid)


def test_upper_cut_hits_only_high_values(df):
    hidden = inject.hide_mnar_quantile(df, FEATS, "row_id", 0.5, 0.25, 0.5, 1, cut="upper")
    assert len(hidden) == 2
    for x, m in hidden.items():
        low = df.filter(m).agg(F.min(x)).first()[0]
        cut = df.stat.approxQuantile(x, [0.75], 0.0)[0]
        assert low >= cut
        assert near(df.filter(m).count() / N, 0.125)


def test_observed_cells_are_unchanged_and_mask_is_stable(df):
    inj = inject.inject(df, FEATS, "row_id", 0.3, single_precision=False)
    both = inj.with_flags()
    assert both.filter(" or ".join(f"(not m_{x} and x_{x} != {x})" for x in FEATS)).count() == 0
    other = inject.inject(df.repartition(13), FEATS, "row_id", 0.3, single_precision=False)
    assert inj.mask.exceptAll(other.mask).count() == 0


def test_lower_rates_are_nested(df, spark):
    grid = spark.createDataFrame([(0.1,), (0.5,)], "p_miss double")
    s = inject.sweep(df, FEATS, "row_id", grid)
    low = s.filter("p_miss = 0.1 and a is null").select("row_id")
    high = s.filter("p_miss = 0.5 and a is null").select("row_id")
    assert low.join(high, "row_id", "left_anti").count() == 0


def test_fixed_counts(df):
    got = null_counts(sampling.hide_fixed_count(df, ["a", "b"], "row_id", 0.1237), ["a", "b", "c"]).collect()
    assert {r["feature"]: r["nulls"] for r in got} == {"a": int(0.1237 * N), "b": int(0.1237 * N), "c": 0}


def test_panel_rows_share_their_gaps(df):
    out = sampling.hide_panel_rows(df, ["a", "b"], "row_id", n=100)
    assert out.filter("a is null and b is null").count() == out.filter("a is null or b is null").count() == 100


def test_folds(df):
    folds = sampling.stratified_folds(df, "row_id", "y", 5).persist()
    assert folds.count() == N == folds.select("row_id").distinct().count()
    sizes = folds.groupBy("y").pivot("fold", list(range(5))).count().collect()
    assert all(max(r[str(i)] for i in range(5)) - min(r[str(i)] for i in range(5)) <= 1 for r in sizes)
    roles = sampling.fold_roles(folds, "row_id", 5, 0.8).persist()
    assert roles.count() == 5 * N
    assert roles.select("fold", "row_id").distinct().count() == 5 * N
    got = {(r["fold"], r["role"]): r["count"] for r in roles.groupBy("fold", "role").count().collect()}
    for f in range(5):
        rest = got[(f, "train")] + got[(f, "val")]
        assert got[(f, "train")] == int(0.8 * rest)


def test_under_and_oversample(df):
    under = {r["y"]: r["count"] for r in sampling.undersample(df, "y", "row_id").groupBy("y").count().collect()}
    assert under[0] == under[1] == df.filter("y = 1").count()
    over = sampling.oversample(df, "y", "row_id")
    sizes = {r["y"]: r["count"] for r in over.groupBy("y").count().collect()}
    assert sizes[0] == sizes[1] == df.filter("y = 0").count()
    assert over.filter("copy = 0").count() == N


def test_no_subject_on_two_sides(spark):
    df = spark.createDataFrame([(s, int(s > 2), i) for s in range(1, 5) for i in range(3)], "subject long, y int, i int")
    out = sampling.split_grouped(df, "subject", "y", 2)
    assert out.count() == out.select("fold", "subject").distinct().count() == 8
    test = out.filter("role = 'test'").groupBy("fold").count().collect()
    assert [r["count"] for r in test] == [2, 2]


def test_split_hook_needs_roles(df):
    with pytest.raises(ValueError):
        sampling.custom_split(df, lambda d: d.select("row_id"))
