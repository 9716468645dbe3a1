"""t tests on result tables. Moments are aggregates; only p-values use a Python function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.student import student_p


def paired_moments(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(n, mean_diff, t, df) of a - b; t is NULL when the differences do not vary."""
    d = F.col(a) - F.col(b)
    s = pairs.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd")
    )
    t = F.try_divide(F.col("mean_diff"), F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    return s.select(*by, "n", "mean_diff", t.alias("t"), (F.col("n") - 1).alias("df"))


def ttest_paired(
    results: DataFrame, by: list[str], rate: str, trial: str, pairs: list[tuple[int, int]], value: str = "value"
) -> DataFrame:
    """Each model at one rate against another, matched by trial; no t when the counts differ."""
    wanted = F.array(*[F.struct(F.lit(a).alias("rate_a"), F.lit(b).alias("rate_b")) for a, b in pairs])
    # every row goes to the comparisons its rate takes part in; one shuffle serves all of them
    sides = results.select(*by, trial, F.col(rate).alias("_r"), F.col(value).alias("_v"), F.inline(wanted)).filter(
        (F.col("_r") == F.col("rate_a")) | (F.col("_r") == F.col("rate_b"))
    )
    keys = [*by, "rate_a", "rate_b"]
    a = F.max(F.when(F.col("_r") == F.col("rate_a"), F.col("_v")))
    b = F.max(F.when(F.col("_r") == F.col("rate_b"), F.col("_v")))
    matched = sides.groupBy(*keys, trial).agg(a.alias("a"), b.alias("b"))
    d = F.col("a") - F.col("b")
    s = matched.groupBy(*keys).agg(
        F.count("a").alias("n_a"),
        F.count("b").alias("n_b"),
        F.count(d).alias("n"),
        F.avg(d).alias("mean_diff"),
        F.stddev_samp(d).alias("_sd"),
    )
    same = (F.col("n_a") == F.col("n_b")) & (F.col("n") == F.col("n_a"))
    t = F.when(same, F.try_divide(F.col("mean_diff"), F.col("_sd") / F.sqrt(F.col("n").cast("double"))))
    return s.select(*keys, "n", "mean_diff", t.alias("t"), (F.col("n") - 1).alias("df"))


def ttest_all_pairs(results: DataFrame, trial: list[str], model: str = "model", value: str = "value") -> DataFrame:
    """Paired t of every pair of models, matched by trial (one row per model in a trial)."""
    pool = results.groupBy(*trial).agg(
        F.sort_array(F.collect_list(F.struct(F.col(model).alias("m"), F.col(value).alias("v")))).alias("a")
    )
    pairs = F.flatten(
        F.transform(
            "a",
            lambda s, i: F.transform(
                F.slice("a", i + 2, F.size("a")),
                lambda z: F.struct(
                    s["m"].alias("model_a"), z["m"].alias("model_b"), s["v"].alias("va"), z["v"].alias("vb")
                ),
            ),
        )
    )
    return paired_moments(pool.select(F.inline(pairs)), ["model_a", "model_b"], "va", "vb")


def ttest_independent(results: DataFrame, by: list[str], rate: str, base: int, value: str = "value") -> DataFrame:
    """Pooled two-sample t of a base rate against every other rate."""
    s = results.groupBy(*by, rate).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )
    a = s.filter(F.col(rate) == base).select(*by, F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("v").alias("v0"))
    b = s.filter(F.col(rate) != base)
    both = b.join(a, by)
    df = F.col("n0") + F.col("n") - 2
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n") - 1) * F.col("v")) / df
    se = F.sqrt(pooled * (1.0 / F.col("n0") + 1.0 / F.col("n")))
    return both.select(*by, F.col(rate), F.try_divide(F.col("m0") - F.col("m"), se).alias("t"), df.alias("df"))


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", student_p(F.col("t").cast("double"), F.col("df").cast("double")))


def significance_flag(p: Column, yes: str = "*", no: str = "NS") -> Column:
    return F.when(p < 0.05, yes).otherwise(no)


def means_and_pvalues(results: DataFrame, by: list[str], rate: str, trial: str, rates: list[int], value: str = "value") -> DataFrame:
    """Long report: means at the given rates and p-values of neighbouring rates."""
    means = (
        results.filter(F.col(rate).isin(rates))
        .groupBy(*by, rate)
        .agg(F.avg(value).alias("v"))
        .select(*by, F.concat(F.lit("mean_"), F.col(rate).cast("string")).alias("item"), "v")
    )
    tests = with_p(ttest_paired(results, by, rate, trial, list(zip(rates, rates[1:])), value))
    label = F.concat_ws("_", F.lit("p"), F.col("rate_a").cast("string"), F.col("rate_b").cast("string"))
    return means.unionByName(tests.select(*by, label.alias("item"), F.col("p_value").alias("v")))
