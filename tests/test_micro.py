"""Hand-worked tables."""

import math
import sys

import pytest
from pyspark.sql import functions as F

from gapweave.functions.student import two_sided_p
from gapweave.operators import blend, diversity, lattice, metrics, significance, threshold
from gapweave.operators.clean import Panel


def one(df):
    return df.first().asDict()


def test_pairs(spark):
    rows = [(1, "p1", 1, 1), (2, "p1", 1, 0), (3, "p1", 0, 0), (4, "p1", 0, 1)]
    rows += [(i, "p2", y, 1) for i, y in [(1, 1), (2, 1), (3, 0), (4, 0)]]
    out = diversity.pair_outcomes(spark.createDataFrame(rows, "row_id long, model string, y int, label int"))
    assert one(out) == {"m1": "p1", "m2": "p2", "n11": 0.25, "n10": 0.25, "n01": 0.25, "n00": 0.25}

    def value(measure):
        return diversity.pairwise(out, measure).first()["value"]

    assert value(diversity.q_statistic) == 0
    assert value(diversity.ratio_errors) == 2
    assert value(diversity.disagreement) == 0.5
    assert value(diversity.agreement) == 0.5
    assert value(diversity.correlation) == 0
    assert value(diversity.negative_double_fault) == -0.25


def test_ratio_without_common_errors(spark):
    df = spark.createDataFrame([("a", "b", 0.5, 0.5, 0.0, 0.0)], "m1 string, m2 string, n11 double, n10 double, n01 double, n00 double")
    assert diversity.pairwise(df, diversity.ratio_errors).first()["value"] == sys.float_info.max


def test_auc_with_tie(spark):
    df = spark.createDataFrame([("m", 0.1, 0), ("m", 0.4, 0), ("m", 0.4, 1), ("m", 0.8, 1)], "model string, p double, y int")
    assert metrics.roc_auc(df, ["model"]).first()["roc_auc"] == pytest.approx(0.875)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([("m", 0.1, 1), ("m", 0.4, 1)], "model string, p double, y int")
    assert metrics.roc_auc(df, ["model"]).first()["roc_auc"] is None


def test_class_metrics(spark):
    df = spark.createDataFrame([("m", 1, 1), ("m", 1, 1), ("m", 0, 1), ("m", 0, 0)], "model string, y int, label int")
    m = one(metrics.class_metrics(metrics.confusion_counts(df, ["model"])))
    assert (m["sensitivity"], m["specificity"], m["ppv"], m["npv"]) == (1.0, 0.5, 0.6667, 1.0)
    assert (m["gmean_sens_spec"], m["gmean_all_metrics"]) == (0.7071, 0.7598)


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([("m", 1, 1)] * 3, "model string, y int, label int")
    m = one(metrics.class_metrics(metrics.confusion_counts(df, ["model"])))
    assert m["specificity"] == m["npv"] == m["gmean_sens_spec"] == m["gmean_all_metrics"] == 0


def test_half_goes_to_even(spark):
    df = spark.createDataFrame([("m", 0.5, 0)], "model string, p double, y int")
    assert metrics.accuracy(df, ["model"]).first()["accuracy"] == 1.0


def test_rank_ties(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.5)], "run int, model string, value double")
    assert {r["model"]: r["rank"] for r in metrics.rank_models(df, ["run"]).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_blend(spark):
    comp = spark.createDataFrame(
        [(1, 0, "a", 1.0, 0.8), (1, 1, "b", 0.0, 0.6), (1, 2, "c", 1.0, 0.4)],
        "row_id long, idx int, model string, p double, c double",
    )
    out = blend.dew(comp, [1, None], 0.5)
    got = {r["top_n"]: r["blend"] for r in out.collect()}
    assert got[1] == 1.0
    assert got[0] == pytest.approx(0.6390, abs=1e-4)
    weights = {(r["top_n"], r["model"]): r["w"] for r in blend.weight_rows(out).collect()}
    assert weights[(0, "a")] == pytest.approx(0.4409, abs=1e-4)
    assert weights[(0, "c")] == pytest.approx(0.1981, abs=1e-4)
    assert weights[(1, "a")] == 1.0


def test_equal_competences_give_the_uniform_blend(spark):
    comp = spark.createDataFrame([(1, i, str(i), p, 0.7) for i, p in enumerate([0.1, 0.5, 0.9])], "row_id long, idx int, model string, p double, c double")
    assert blend.dew(comp, [None]).first()["blend"] == pytest.approx(0.5)


def test_multi_class_error(spark):
    df = spark.createDataFrame([(2, [0.2, 0.3, 0.5])], "y int, probs array<double>")
    assert df.select(blend.error_classify_multi(F.col("y"), F.col("probs"))).first()[0] == pytest.approx(0.5)
    assert df.select(blend.argmax_label(F.col("probs"))).first()[0] == 2


def test_kl(spark):
    df = spark.createDataFrame([("r", 0.5, 0.25), ("r", 0.5, 0.5), ("r", 0.0, 0.25)], "run string, a double, b double")
    assert metrics.kl_divergence(df, ["run"], "a", "b").first()["kl"] == pytest.approx(0.5 * math.log(2))


def test_lattice(spark):
    panels = [Panel("A", ["a"]), Panel("B", ["b"])]
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 2.0), (3, None, None)], "row_id long, a double, b double")
    got = {r["row_id"]: r for r in df.select("row_id", lattice.panel_mask(panels).alias("m"), lattice.row_level({"a": "A", "b": "B"}, 2).alias("level")).collect()}
    assert {k: (r["m"], r["level"]) for k, r in got.items()} == {1: (1, 1), 2: (3, 2), 3: (0, 0)}
    nodes = lattice.lattice_build(spark, panels, ["x"])
    assert nodes.count() == 4
    assert {r["node_mask"]: r["features"] for r in nodes.collect()}[3] == ["x", "a", "b"]
    assert lattice.lattice_edges(nodes, 2).count() == 4
    full = spark.createDataFrame([(3,)], "node_mask long")
    assert sorted(r["ancestor"] for r in lattice.ancestors(full, 2, proper=True).collect()) == [0, 1, 2]


def test_lattice_average_wide_equals_long(spark):
    df = spark.createDataFrame([(1, 3, 0.1, 0.2, 0.3, 0.6), (2, 1, 0.5, 0.7, None, None)], "row_id long, mask long, p0 double, p1 double, p2 double, p3 double")
    wide = {r[0]: r[1] for r in df.select("row_id", lattice.lattice_average_wide({0: "p0", 1: "p1", 2: "p2", 3: "p3"}, "mask")).collect()}
    long = df.unpivot(["row_id"], ["p0", "p1", "p2", "p3"], "n", "p").filter("p is not null").withColumn("node_mask", F.substring("n", 2, 1).cast("long"))
    got = {r["row_id"]: r["p"] for r in lattice.lattice_average(df.select("row_id", "mask"), long.select("row_id", "node_mask", "p")).collect()}
    assert got == pytest.approx(wide)


def test_paired_t(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 2.0, 2.0), ("m", 3.0, 4.0), ("m", 4.0, 5.0)], "model string, a double, b double")
    t = significance.with_p(significance.paired_moments(df, ["model"], "a", "b")).first()
    assert (round(t["t"], 9), t["df"]) == (-3.0, 3)
    assert t["p_value"] == pytest.approx(0.057669, abs=1e-6)


def test_student_tail():
    # closed forms: one and two degrees of freedom
    for t in (0.1, 0.7, 1.5, 4.0, 30.0):
        assert two_sided_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert two_sided_p(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-8)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert math.isnan(two_sided_p(float("nan"), 5))


def test_sweep_against_row_loop(spark):
    import random

    rng = random.Random(5)
    rows = [("m", rng.choice([0, 1]), round(rng.random(), 2)) for _ in range(200)] + [("m", 1, 1.0), ("m", 0, 0.0)]
    df = spark.createDataFrame(rows, "model string, y int, p double")
    got = {r["i"]: r for r in threshold.threshold_sweep(df, ["model"], step=1.0).collect()}
    assert sorted(got) == list(range(1, 100))
    for i, r in got.items():
        tp = sum(1 for _, y, p in rows if y and p >= i / 100)
        fp = sum(1 for _, y, p in rows if not y and p >= i / 100)
        assert (r["tp"], r["fp"]) == (tp, fp), i
    best = max(range(1, 100), key=lambda i: (round(got[i]["gmean_all_metrics"], 12), -i))
    sweep = threshold.threshold_sweep(df, ["model"], step=1.0)
    assert threshold.best_threshold(sweep, ["model"], 1.0).first()["threshold"] == pytest.approx((best - 1) / 100)
    assert threshold.best_threshold(sweep, ["model"], 1.0, exact=True).first()["threshold"] == pytest.approx(best / 100)
    assert threshold.threshold_sweep(df, [], step=1.0).count() == 99
