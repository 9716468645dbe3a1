"""Pairwise diversity of classifiers, from right/wrong outcomes."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Measure = Callable[[Column, Column, Column, Column], Column]  # n11, n10, n01, n00


def pair_outcomes(labels: DataFrame, row: str = "row_id", y: str = "y") -> DataFrame:
    """(m1, m2, n11, n10, n01, n00) as shares of rows; n10 means only m1 is right.

    ``labels`` is long: row, model, y, label. The pool of a row is gathered in
    one array (one entry per model) and unfolded into pairs, so rows are
    shuffled once instead of being joined with themselves.
    """
    right = (F.col("label") == F.col(y)).alias("ok")
    pool = labels.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("model", right))).alias("a"))
    pairs = F.flatten(
        F.transform(
            "a",
            lambda s, i: F.transform(
                F.slice("a", i + 2, F.size("a")),
                lambda t: F.struct(
                    s["model"].alias("m1"), t["model"].alias("m2"), s["ok"].alias("r1"), t["ok"].alias("r2")
                ),
            ),
        )
    )
    both = pool.select(F.inline(pairs))
    r1, r2 = F.col("r1"), F.col("r2")
    return both.groupBy("m1", "m2").agg(
        F.avg((r1 & r2).cast("double")).alias("n11"),
        F.avg((r1 & ~r2).cast("double")).alias("n10"),
        F.avg((~r1 & r2).cast("double")).alias("n01"),
        F.avg((~r1 & ~r2).cast("double")).alias("n00"),
    )


def double_fault(n11, n10, n01, n00) -> Column:
    return n00


def negative_double_fault(n11, n10, n01, n00) -> Column:
    return -n00


def q_statistic(n11, n10, n01, n00) -> Column:
    return F.try_divide(n11 * n00 - n01 * n10, n11 * n00 + n01 * n10)


def ratio_errors(n11, n10, n01, n00) -> Column:
    """Different errors over common errors; the largest double when there is no common error."""
    return F.coalesce(F.try_divide(n01 + n10, n00), F.lit(sys.float_info.max))


def disagreement(n11, n10, n01, n00) -> Column:
    return n10 + n01


def agreement(n11, n10, n01, n00) -> Column:
    return n00 + n11


def correlation(n11, n10, n01, n00) -> Column:
    den = F.sqrt((n11 + n01) * (n10 + n00) * (n11 + n10) * (n01 + n00))
    return F.try_divide(n11 * n00 - n10 * n01, den)


def pairwise(outcomes: DataFrame, measure: Measure, out: str = "value") -> DataFrame:
    cols = [F.col(x) for x in ("n11", "n10", "n01", "n00")]
    return outcomes.select("m1", "m2", measure(*cols).alias(out))


def pool_diversity(outcomes: DataFrame, measure: Measure) -> DataFrame:
    """Sum of a measure over all partners of each classifier."""
    v = pairwise(outcomes, measure)
    ends = v.select(F.explode(F.array("m1", "m2")).alias("model"), "value")
    return ends.groupBy("model").agg(F.sum("value").alias("diversity"))
