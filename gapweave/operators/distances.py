"""Scale of pairwise distances, from a bounded sample of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.draw import draw
from gapweave.operators.impute import MeanImputer
from gapweave.operators.ordered import kth_values
from gapweave.session import cut

MAX_POINTS = 2000


def pair_scale(
    df: DataFrame, features: list[str], id_col: str, quant: float = 0.5, mult: float = 0.05,
    max_points: int = MAX_POINTS, seed: int = 0,
) -> DataFrame:
    """``mult`` times a quantile of the halved squared distances between mean-filled rows.

    Sampling is part of the definition: at most ``max_points`` rows take part,
    so there are at most max_points squared pairs. They are made by unfolding
    the array of sampled rows next to each sampled row.
    """
    filled = MeanImputer(features).fit(df).transform(df)
    sample = cut(filled.orderBy(draw(id_col, "pairs", seed), id_col).limit(max_points).select(*features))
    points = [list(r) for r in sample.collect()]  # max_points rows at most
    spark = df.sparkSession
    width = spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast(points)

    def halves(batches):
        import numpy as np
        import pandas as pd

        other = np.array(shared.value, dtype=float)
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            for i in range(0, len(x), 64):
                total = np.zeros((len(x[i : i + 64]), len(other)))
                for j in range(x.shape[1]):
                    d = x[i : i + 64, j, None] - other[None, :, j]
                    total += d * d
                h = total.ravel() / 2.0
                yield pd.DataFrame({"h": h[h > 0]})

    pairs = cut(sample.repartition(width).mapInPandas(halves, "h double"))
    n = pairs.count()
    if n == 0:
        return spark.createDataFrame([(None,)], "epsilon double")
    value = kth_values(pairs, {"h": [max(1, int(quant * n))]})["h"][0]
    return spark.createDataFrame([(value * mult,)], "epsilon double")
