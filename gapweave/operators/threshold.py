"""Threshold sweeps from a score histogram.

A row enters one histogram cell (the number of cut-offs its score reaches);
counts of all cut-offs are running sums over the cells, so rows are never
multiplied by the number of cut-offs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapweave.functions.scalar import clip
from gapweave.operators.metrics import class_metrics


def threshold_sweep(df: DataFrame, by: list[str], y: str = "y", p: str = "p", step: float = 0.1) -> DataFrame:
    """Six metrics for each cut-off i/N, i = 1..N-1, N = int(100/step); label 1 iff p >= i/N."""
    if not by:
        return threshold_sweep(df.withColumn("_all", F.lit(0)), ["_all"], y, p, step).drop("_all")
    n = int(100 / step)
    # number of cut-offs reached; the division may be off by one unit, so it is checked
    guess = F.floor(F.col(p) * n)
    guess = F.when((guess + 1) / F.lit(float(n)) <= F.col(p), guess + 1).otherwise(guess)
    guess = F.when(guess / F.lit(float(n)) > F.col(p), guess - 1).otherwise(guess)
    cell = clip(guess.cast("double"), 0.0, float(n - 1)).cast("int")
    pos = F.col(y) != 0
    hist = df.groupBy(*by, cell.alias("i")).agg(F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    # every cut-off of every group, also those no score falls into
    grid = hist.select(*by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    full = grid.join(hist, [*by, "i"], "left").na.fill(0, ["pos", "neg"])
    up = W.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    counts = full.select(
        *by,
        "i",
        F.sum("pos").over(up).alias("tp"),
        F.sum("neg").over(up).alias("fp"),
        F.coalesce(F.sum("neg").over(down), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("fn"),
    ).filter("i >= 1")
    return class_metrics(counts, None).withColumn("cutoff", F.col("i") / F.lit(float(n)))


def best_threshold(sweep: DataFrame, by: list[str], step: float = 0.1, exact: bool = False) -> DataFrame:
    """Cut-off with the first maximum of the 4-way mean.

    By default the returned value is one step below the one evaluated, as in
    the study; ``exact`` returns the evaluated one.
    """
    n = int(100 / step)
    best = sweep.groupBy(*by).agg(F.max(F.struct(F.round("gmean_all_metrics", 12).alias("g"), (-F.col("i")).alias("i"))).alias("b"))
    i = -F.col("b.i")
    at = i if exact else i - 1
    return best.select(*by, (at / F.lit(float(n))).alias("threshold"), F.col("b.g").alias("gmean_all_metrics"))


def curve_summary(sweep: DataFrame, by: list[str]) -> DataFrame:
    aggs = []
    for g in ("gmean_sens_spec", "gmean_all_metrics"):
        aggs += [F.max(g).alias(f"max_{g}"), F.avg(g).alias(f"mean_{g}")]
    return sweep.groupBy(*by).agg(*aggs)
