"""Blending the predictions of a pool of impute-and-predict pipelines.

The flagship weighs each pipeline per row: its accuracy on the row's nearest
validation rows, in that pipeline's own imputed space, becomes a competence,
and competences become softmax weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.scalar import c, clip, softmax_array
from gapweave.operators.knn import knn_join

DIGITS = 9  # competences are rounded before they are ordered


@dataclass
class PoolMember:
    """One pipeline's view: imputed features and own prediction of each row.

    ``val``: id, features, y, p. ``test``: id, features, p.
    """

    name: str
    val: DataFrame
    test: DataFrame


def blend_uniform(preds: DataFrame, row: list[str], p: str = "p") -> DataFrame:
    return preds.groupBy(*row).agg(F.avg(p).alias("blend"))


def error_classify(y: str | Column = "y", p: str | Column = "p") -> Column:
    """max over classes of clip(onehot(y) - p, 0, 1); ``p`` is the probability of class 1."""
    p1 = c(p)
    one = F.when(c(y) == 1, 1.0).otherwise(0.0)
    return F.greatest(clip(one - p1, 0.0, 1.0), clip((1.0 - one) - (1.0 - p1), 0.0, 1.0))


def error_classify_multi(y: Column, probs: Column) -> Column:
    """The same for a vector of class probabilities and a class index."""
    gaps = F.transform(probs, lambda p, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(y == i, 1.0).otherwise(0.0) - p)))
    return F.array_max(gaps)


def error_regress(y: str | Column = "y", p: str | Column = "p") -> Column:
    return F.abs(c(y) - c(p))


def argmax_label(probs: Column) -> Column:
    """Index of the most probable class, the first one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def neighbours(pool: list[PoolMember], features: list[str], k: int, regression: bool = False, **knn) -> DataFrame:
    """(row_id, idx, model, p, rank, val_id, e, dist): neighbours of each test row in each pipeline's space.

    The error of the validation row and the prediction of the test row travel
    with the search, so neither is joined back.
    """
    err = error_regress() if regression else error_classify()
    parts = []
    for idx, m in enumerate(pool):
        val = m.val.withColumn("e", err)
        pairs = knn_join(m.test, val, features, k, carry=["p"], payload=["e"], **knn)
        parts.append(pairs.withColumns({"idx": F.lit(idx), "model": F.lit(m.name)}))
    return reduce(DataFrame.unionByName, parts)


def competences(near: DataFrame, regression: bool = False) -> DataFrame:
    """(row_id, idx, model, p, c): mean neighbour accuracy, or minus the mean error."""
    value = -F.avg("e") if regression else F.avg(1.0 - F.col("e"))
    return near.groupBy("row_id", "idx", "model").agg(F.first("p").alias("p"), F.round(value, DIGITS).alias("c"))


def dew(
    comp: DataFrame, top_n: list[int | None], threshold: float | None = 0.5, row: list[str] | None = None
) -> DataFrame:
    """(row_id, top_n, blend, weights) from competences; ``top_n`` 0 stands for the whole pool.

    One shuffle: a row's pool (one entry per pipeline) is gathered in an array
    and every requested ``top_n`` is computed from it. Competences at or below
    the threshold become 0 after the selection; their weight is then
    exp(0) / sum, not 0.
    """
    row = row or ["row_id"]
    entry = F.struct((-F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0))).alias("key"), "idx", "model", "p")
    pool = comp.groupBy(*row).agg(F.sort_array(F.collect_list(entry)).alias("_pool"))
    wanted = F.array(*[F.lit(0 if n in (None, -1) else n) for n in top_n])
    picked = pool.withColumn("top_n", F.explode(wanted)).withColumn(
        "_sel", F.when(F.col("top_n") == 0, F.col("_pool")).otherwise(F.slice("_pool", 1, F.greatest("top_n", F.lit(1))))
    )
    score = F.transform("_sel", lambda s: -s["key"])
    if threshold is not None:
        score = F.transform(score, lambda v: F.when(v > threshold, v).otherwise(0.0))
    picked = picked.withColumn("_w", softmax_array(score))
    blend = F.aggregate(
        F.zip_with("_w", "_sel", lambda w, s: w * s["p"]), F.lit(0.0), lambda a, v: a + v
    )
    weights = F.zip_with("_w", "_sel", lambda w, s: F.struct(s["idx"].alias("idx"), s["model"].alias("model"), w.alias("w")))
    return picked.select(*row, "top_n", blend.alias("blend"), weights.alias("weights"))


def weight_rows(blended: DataFrame, row: list[str] | None = None) -> DataFrame:
    """Long weights; pipelines that were not selected have no row (weight 0)."""
    row = row or ["row_id"]
    return blended.select(*row, "top_n", F.inline("weights"))


def weights_all(comp: DataFrame, row: list[str] | None = None) -> DataFrame:
    """Softmax of all competences, no threshold."""
    return weight_rows(dew(comp, [0], None, row), row).drop("top_n")


def global_competences(val_errors: DataFrame) -> DataFrame:
    """Per pipeline over all validation rows: mean / (SD + 0.01) of accuracy, 0 unless the mean exceeds 0.5."""
    a = 1.0 - F.col("e")
    s = val_errors.groupBy("idx", "model").agg(F.avg(a).alias("m"), F.stddev_pop(a).alias("s"))
    value = F.when(F.col("m") > 0.5, F.col("m") / (F.col("s") + 0.01)).otherwise(0.0)
    return s.select("idx", "model", F.round(value, DIGITS).alias("c"))


def dew_global(test_preds: DataFrame, comp: DataFrame, top_n: list[int | None], threshold: float = 0.5) -> DataFrame:
    """Blend with row-independent competences (``comp``: one row per pipeline)."""
    return dew(test_preds.join(F.broadcast(comp), ["idx", "model"]), top_n, threshold)


def dew_classify(
    pool: list[PoolMember], features: list[str], k: int, top_n: list[int | None], threshold: float = 0.5, **knn
) -> DataFrame:
    return dew(competences(neighbours(pool, features, k, **knn)), top_n, threshold)


def dew_regress(pool: list[PoolMember], features: list[str], k: int, top_n: list[int | None], **knn) -> DataFrame:
    return dew(competences(neighbours(pool, features, k, True, **knn), True), top_n, None)


def top_members(comp: DataFrame, n: int, row: list[str] | None = None) -> DataFrame:
    """The n most competent pipelines of each row; ties by pipeline order."""
    row = row or ["row_id"]
    pool = comp.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("key"), "idx", "model"))).alias("_p"))
    return pool.select(*row, F.posexplode(F.slice("_p", 1, n)).alias("pos", "s")).select(
        *row, (F.col("pos") + 1).alias("pos"), F.col("s.model").alias("model"), (-F.col("s.key")).alias("c")
    )


