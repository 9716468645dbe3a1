"""Metrics as aggregates. Every function keeps ``by`` as the grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapweave.functions.scalar import c, half_even, ratio
from gapweave.operators.ordered import cumulative
from gapweave.session import cut


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.lit(len(df.columns)).cast("long").alias("n_cols"), F.count(F.lit(1)).alias("n_rows"))


def class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def task_type(df: DataFrame, target: str) -> DataFrame:
    """'classification' when the target has fewer values than the root of the row count."""
    s = df.agg(F.count_distinct(target).alias("n_values"), F.count(F.lit(1)).alias("n_rows"))
    kind = F.when(F.col("n_values") < F.sqrt("n_rows"), "classification").otherwise("regression")
    return s.withColumn("task", kind)


def confusion_counts(df: DataFrame, by: list[str], y: str = "y", label: str = "label") -> DataFrame:
    """Everything that is not 0 counts as positive truth; only 1 counts as positive guess."""
    pos = F.col(y) != 0
    return df.groupBy(*by).agg(
        F.count_if(pos & (F.col(label) == 1)).alias("tp"),
        F.count_if(~pos & (F.col(label) == 0)).alias("tn"),
        F.count_if(~pos & (F.col(label) != 0)).alias("fp"),
        F.count_if(pos & (F.col(label) != 1)).alias("fn"),
    )


def class_metrics(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Six rates from tp/tn/fp/fn; undefined ones are 0."""
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    df = counts.withColumns(
        {
            "sensitivity": ratio(tp, tp + fn),
            "specificity": ratio(tn, tn + fp),
            "ppv": ratio(tp, tp + fp),
            "npv": ratio(tn, tn + fn),
        }
    )
    sens, spec, ppv, npv = (F.col(x) for x in ("sensitivity", "specificity", "ppv", "npv"))
    df = df.withColumns(
        {
            "gmean_sens_spec": F.sqrt(sens * spec),
            "gmean_all_metrics": F.pow(sens * spec * ppv * npv, F.lit(0.25)),
        }
    )
    if digits is None:
        return df
    names = ["sensitivity", "specificity", "ppv", "npv", "gmean_sens_spec", "gmean_all_metrics"]
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def accuracy(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    hit = (half_even(p) == F.col(y)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def f1_score(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    guess, truth = half_even(p) == 1, F.col(y) == 1
    s = df.groupBy(*by).agg(
        F.count_if(guess & truth).alias("_tp"),
        F.count_if(guess & ~truth).alias("_fp"),
        F.count_if(~guess & truth).alias("_fn"),
    )
    tp = F.col("_tp")
    return s.select(*by, ratio(2 * tp, 2 * tp + F.col("_fp") + F.col("_fn")).alias("f1_score"))


def roc_auc(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows are first reduced to one row per distinct score; positions come from
    bucketed running totals, so no task ever sorts a whole group. NULL when a
    class is absent.
    """
    truth = F.col(y) == 1
    scores = df.groupBy(*by, c(p).alias("_score")).agg(
        F.count_if(truth).alias("_pos"), F.count_if(~truth).alias("_neg")
    )
    # the scores feed three passes; written once so that their source runs once
    ranked = cumulative(cut(scores), by, "_score", ["_neg"])
    area = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") * 0.5))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by).agg(F.try_divide(area, pairs).alias("roc_auc"))


def mean_abs_error(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"))


def cells(df: DataFrame, id_cols: list[str], features: list[str], value: str) -> DataFrame:
    """Wide to (ids, feature, value); nulls are kept."""
    return df.unpivot(id_cols, features, "feature", value)


def masked_errors(
    pairs: DataFrame, by: list[str], truth: str = "truth", filled: str = "filled", missing: str = "is_missing"
) -> DataFrame:
    """Mean absolute and root mean squared error over the injected cells."""
    d = F.col(filled) - F.col(truth)
    return (
        pairs.filter(F.col(missing))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.avg(F.abs(d)).alias("mae"),
            F.sqrt(F.avg(d * d)).alias("rmse"),
        )
    )


def masked_errors_wide(
    df: DataFrame, features: list[str], truth: dict[str, str], filled: dict[str, str], missing: dict[str, Column]
) -> DataFrame:
    """Per-feature errors when truth, filled value and mask lie in one row.

    One aggregate over the row, no unpivot and no join; the result (one row)
    is turned on its side afterwards.
    """
    aggs = []
    for f in features:
        d = F.when(missing[f], F.col(filled[f]) - F.col(truth[f]))
        aggs.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count(d).alias("n_cells"),
                F.avg(F.abs(d)).alias("mae"),
                F.sqrt(F.avg(d * d)).alias("rmse"),
            )
        )
    return df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, upper triangle, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    aggs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a), F.col(b)).alias("corr"))
        for a, b in pairs
    ]
    return df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))


def normality_test(df: DataFrame, cols: list[str]) -> DataFrame:
    """D'Agostino-Pearson K2 and its p-value for each column (one pass).

    Closed forms of D'Agostino, Belanger and D'Agostino (1990); the p-value of
    a chi-square with two degrees of freedom is exp(-K2 / 2).
    """
    aggs = [
        F.struct(
            F.lit(x).alias("feature"),
            F.count(F.col(x)).cast("double").alias("n"),
            F.skewness(F.col(x)).alias("skew"),
            F.kurtosis(F.col(x)).alias("excess"),
        )
        for x in cols
    ]
    m = df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))
    n = F.col("n")
    # skewness part
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1
    m = m.withColumns({"_y": y, "_w2": w2})
    delta = 1.0 / F.sqrt(0.5 * F.ln("_w2"))
    alpha = F.sqrt(2.0 / (F.col("_w2") - 1))
    t = F.col("_y") / alpha
    z_skew = delta * F.ln(t + F.sqrt(t * t + 1))
    # kurtosis part
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("excess") + 3.0 - e) / F.sqrt(var)
    root_beta1 = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    m = m.withColumns({"_x": x, "_rb": root_beta1})
    a = 6.0 + 8.0 / F.col("_rb") * (2.0 / F.col("_rb") + F.sqrt(1.0 + 4.0 / (F.col("_rb") * F.col("_rb"))))
    m = m.withColumn("_a", a)
    core = (1.0 - 2.0 / F.col("_a")) / (1.0 + F.col("_x") * F.sqrt(2.0 / (F.col("_a") - 4.0)))
    root = F.signum(core) * F.pow(F.abs(core), F.lit(1.0 / 3.0))
    z_kurt = (1.0 - 2.0 / (9.0 * F.col("_a")) - root) / F.sqrt(2.0 / (9.0 * F.col("_a")))
    m = m.withColumns({"_zs": z_skew, "_zk": z_kurt})
    k2 = F.col("_zs") * F.col("_zs") + F.col("_zk") * F.col("_zk")
    return m.select("feature", k2.alias("k2"), F.exp(-k2 / 2.0).alias("p_value"))


def calibration_curve(df: DataFrame, by: list[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Mean prediction and share of positives in uniform bins of p; empty bins do not appear."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean_predicted"),
        F.avg((F.col(y) == 1).cast("double")).alias("fraction_positive"),
    )


def kl_divergence(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    term = F.when(F.col(a) != 0, F.col(a) * F.ln(F.col(a) / F.col(b))).otherwise(0.0)
    return df.groupBy(*by).agg(F.sum(term).alias("kl"))


def weighted_error(df: DataFrame, by: list[str], w: str = "w", e: str = "e") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.col(w) * F.col(e)).alias("weighted_error"))


def blend_vs_uniform(errors: DataFrame, run: str = "run", row: str = "row_id", blend: str = "blend") -> DataFrame:
    """How often a blend beats the mean error of its pool, for each run.

    ``errors`` is long: run, row, model, e. ``winner_any`` names the blend as
    soon as it wins one row; ``winner`` asks for more than half.
    """
    is_blend = F.col("model") == blend
    per_row = errors.groupBy(run, row).agg(
        F.max(F.when(is_blend, F.col("e"))).alias("_b"),
        F.avg(F.when(~is_blend, F.col("e"))).alias("_u"),
    )
    out = per_row.groupBy(run).agg(
        F.avg((F.col("_b") < F.col("_u")).cast("double")).alias("share"),
        F.avg("_b").alias("blend_error"),
        F.avg("_u").alias("uniform_error"),
    )
    return out.withColumns(
        {
            "winner_any": F.when(F.col("share") != 0, "blend").otherwise("uniform"),
            "winner": F.when(F.col("share") > 0.5, "blend").otherwise("uniform"),
            "error_ratio": ratio(F.col("blend_error"), F.col("uniform_error"), None),
        }
    )


def summary_stats(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Median, mean and sample SD of a results table (one row per run and model)."""
    return results.groupBy(*by).agg(
        F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def mean_std(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def box_stats(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Quartiles, whiskers and outlier count of each box of a chart."""
    q = results.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(["q1", "q2", "q3"])])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(lo, hi)
    return (
        results.join(q, by)
        .groupBy(*by, "q1", "q2", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def rank_models(results: DataFrame, run: list[str], value: str = "value") -> DataFrame:
    """Descending rank of the models of each run, ties averaged. A run holds one row per model."""
    by_value = W.partitionBy(*run).orderBy(F.desc(value))
    tied = W.partitionBy(*run, value)
    rank = F.rank().over(by_value) + (F.count(F.lit(1)).over(tied) - 1) / 2.0
    return results.withColumn("rank", rank)


def rank_summary(ranked: DataFrame, by: list[str]) -> DataFrame:
    return summary_stats(ranked, by, "rank")


def error_order(preds: DataFrame, row: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Per row, models by falling absolute error. A row holds one prediction per model."""
    e = preds.withColumn("abs_error", F.abs(F.col(p) - F.col(y)))
    w = W.partitionBy(*row).orderBy(F.desc("abs_error"), "model")
    return e.withColumn("pos", F.row_number().over(w))


def best_per_cell(results: DataFrame, cell: list[str], idx: str = "idx", value: str = "value") -> DataFrame:
    """First best model of each cell."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(idx)).alias("i")))
    return results.groupBy(*cell).agg(best.alias("_b")).select(
        *cell, F.col("_b.v").alias("best_value"), (-F.col("_b.i")).alias("best_idx")
    )
