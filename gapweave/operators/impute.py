"""Imputers: fitted on one table, applied to any other.

The simple ones keep a few constants and apply as a projection. The iterative
ridge imputer needs only sums of products by pattern of gaps, which Spark adds
up in one scan; the small systems are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.operators import gaptrees
from gapweave.operators.knn import knn_join
from gapweave.operators.patterns import LinearStep, PatternTable, known
from gapweave.session import cut


@dataclass
class Constants:
    """Fill each column with its own constant; usable on streams."""

    values: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {x: v for x, v in self.values.items() if v is not None}
        return df.withColumns({x: F.coalesce(F.col(x), F.lit(v)) for x, v in fill.items()})


class MeanImputer:
    def __init__(self, features: list[str]):
        self.features = features

    def fit(self, df: DataFrame) -> Constants:
        row = df.agg(*[F.avg(x).alias(x) for x in self.features]).first()
        return Constants({x: row[x] for x in self.features})


class ModeImputer:
    """Most frequent value, the smallest one on ties. Counts meet in one shuffle for all columns."""

    def __init__(self, features: list[str]):
        self.features = features

    def fit(self, df: DataFrame) -> Constants:
        counts = (
            df.select(*self.features)
            .unpivot([], self.features, "feature", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        most = counts.groupBy("feature").agg(F.max("n").alias("n"))
        best = counts.join(most, ["feature", "n"]).groupBy("feature").agg(F.min("value").alias("value"))
        return Constants({r["feature"]: r["value"] for r in best.collect()})  # one row per column


class ConstantImputer:
    def __init__(self, features: list[str], value: float = 0.0):
        self.features, self.value = features, value

    def fit(self, df: DataFrame) -> Constants:
        return Constants({x: self.value for x in self.features})


class IdentityImputer:
    def __init__(self, features: list[str] | None = None):
        self.features = list(features or [])

    def fit(self, df: DataFrame) -> IdentityImputer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df


@dataclass
class KnnFill:
    """Donor means; see :class:`KnnImputer`."""

    donors: DataFrame
    features: list[str]
    donor_id: str
    k: int
    weighted: bool
    means: Constants
    max_cells: int | None = None

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        """Fill gaps column by column; rows without usable donors take the column mean."""
        df = cut(df)  # read once per column below
        fills = []
        for target in self.features:
            gaps = df.filter(F.col(target).isNull())
            donors = self.donors.filter(F.col(target).isNotNull())
            extra = {} if self.max_cells is None else {"max_cells": self.max_cells}
            pairs = knn_join(
                gaps,
                donors.withColumn("_donated", F.col(target)),
                self.features,
                self.k,
                query_id=id_col,
                ref_id=self.donor_id,
                payload=["_donated"],
                nan_aware=True,
                **extra,
            )
            fills.append(pairs.select(id_col, F.lit(target).alias("_target"), "_donated", "dist"))
        # the donors of all columns meet in one shuffle and come back in one join
        every = reduce(DataFrame.unionByName, fills)
        filled = every.groupBy(id_col).agg(*[self._value(x).alias(f"_f_{x}") for x in self.features])
        out = df.join(filled, id_col, "left")
        return self.means.transform(
            out.select(
                *[
                    F.coalesce(F.col(x), F.col(f"_f_{x}")).alias(x) if x in self.features else F.col(x)
                    for x in df.columns
                ]
            )
        )

    def _value(self, target: str) -> Column:
        mine = F.col("_target") == target
        if not self.weighted:
            return F.avg(F.when(mine, F.col("_donated")))
        # a donor at distance zero outweighs all others
        exact = mine & (F.col("dist") == 0)
        w = F.when(mine & (F.col("dist") > 0), 1.0 / F.when(F.col("dist") > 0, F.col("dist")))
        far = F.try_divide(F.sum(w * F.col("_donated")), F.sum(w))
        return F.coalesce(F.avg(F.when(exact, F.col("_donated"))), far)


class KnnImputer:
    """Mean of the k nearest donors that have the column, nan-aware distances."""

    def __init__(
        self, features: list[str], id_col: str, k: int = 5, weighted: bool = False, max_cells: int | None = None
    ):
        self.features, self.id_col, self.k, self.weighted, self.max_cells = features, id_col, k, weighted, max_cells

    def fit(self, df: DataFrame) -> KnnFill:
        means = MeanImputer(self.features).fit(df)
        donors = cut(df.select(self.id_col, *self.features))
        return KnnFill(donors, self.features, self.id_col, self.k, self.weighted, means, self.max_cells)


# ---- iterative ridge -------------------------------------------------------


@dataclass
class IterativeRidge:
    """Start values and the ordered regressions that were fitted."""

    features: list[str]
    start: Constants
    steps: list[LinearStep]
    rounds: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply all fitted regressions in order, one pass over the rows."""
        feats, steps = self.features, self.steps
        names = df.columns
        if steps:
            df = df.withColumns({x: known(x) for x in feats})
        flagged = self.start.transform(df.withColumns({f"_g_{x}": F.col(x).isNull() for x in feats}))
        if not steps:
            return flagged.select(*names)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series, gaps: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            m, g = np.vstack(x.to_numpy()).astype(float), np.vstack(gaps.to_numpy()).astype(bool)
            _run_steps(m, g, steps)
            return pd.Series(list(m))

        filled = flagged.withColumn(
            "_x",
            run(
                F.array(*[F.col(x).cast("double") for x in feats]),
                F.array(*[F.col(f"_g_{x}") for x in feats]),
            ),
        )
        return filled.select(
            *[F.col("_x")[feats.index(x)].alias(x) if x in feats else F.col(x) for x in names]
        )


def _run_steps(m: np.ndarray, gaps: np.ndarray, steps: list[LinearStep]) -> None:
    for s in steps:
        hit = gaps[:, s.target]
        if hit.any():
            m[hit, s.target] = m[hit] @ s.coef + s.intercept


class IterativeRidgeImputer:
    """Round-robin regression on sums of products by pattern of gaps (:mod:`gapweave.operators.patterns`).

    One scan for means and counts, one for the sums; all columns and rounds then work on the patterns. Rounds end when
    no filled value moves by ``tolerance`` of the largest absolute value. That is settled by bounds from the patterns,
    and by a look at the rows only where the bounds lie on both sides of it. ``bayes`` chooses the evidence
    based strength (MacKay 1992); otherwise ``strength`` is a fixed ridge. ``targets`` are the columns to fit, all by
    default, taken from the fewest gaps to the most (``order`` "ascending") or as given ("roman"). A column without any
    value stays as it is and takes no part; NaN is a gap.
    """

    def __init__(
        self,
        features: list[str],
        rounds: int = 10,
        tolerance: float = 1e-3,
        bayes: bool = True,
        strength: float = 1.0,
        targets: list[str] | None = None,
        order: str = "ascending",
    ):
        self.features, self.rounds, self.tolerance = features, rounds, tolerance
        self.bayes, self.strength, self.targets, self.order = bayes, strength, targets, order

    def fit(self, df: DataFrame) -> IterativeRidge:
        row = df.agg(
            *[F.avg(known(x)).alias(f"m_{x}") for x in self.features],
            *[F.count_if(known(x).isNull()).alias(f"n_{x}") for x in self.features],
            *[F.max(F.abs(known(x))).alias(f"a_{x}") for x in self.features],
        ).first()
        feats = [x for x in self.features if row[f"m_{x}"] is not None]
        start = Constants({x: row[f"m_{x}"] for x in feats})
        wanted = set(self.targets or feats)
        order = [i for i, x in enumerate(feats) if row[f"n_{x}"] and x in wanted]
        if self.order == "ascending":
            order.sort(key=lambda i: (row[f"n_{feats[i]}"], i))
        if not order:
            return IterativeRidge(feats, start, [], 0)
        limit = self.tolerance * max(row[f"a_{x}"] for x in feats)
        centre = np.array([start.values[x] for x in feats])
        sums = PatternTable(df, feats, start.values)
        steps: list[LinearStep] = []
        done = 0
        for done in range(1, self.rounds + 1):
            before = len(steps)
            for j in order:
                others = [i for i in range(len(feats)) if i != j]
                coef, intercept = _solve(sums.sums(j), others, j, None if self.bayes else self.strength)
                sums.apply(LinearStep(j, coef, intercept))
                steps.append(LinearStep(j, coef, float(intercept + centre[j] - coef @ centre)))
            if done > 1 and self._settled(df, feats, start, sums, steps, before, limit):
                break
        return IterativeRidge(feats, start, steps, done)

    def _settled(
        self, df: DataFrame, feats: list[str], start: Constants, sums: PatternTable, steps: list[LinearStep], before: int, limit: float
    ) -> bool:
        low, high = sums.move(before)
        if high < limit or low >= limit:
            return high < limit
        old, new = steps[:before], steps[before:]
        centre = np.array([start.values[x] for x in feats])

        def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = 0.0
            for pdf in batches:
                m = pdf.to_numpy(dtype=float).copy()
                g = np.isnan(m)
                m = np.where(g, centre, m)
                _run_steps(m, g, old)
                was = m.copy()
                _run_steps(m, g, new)
                top = max(top, float(np.abs(m - was).max(initial=0.0)))
            yield pd.DataFrame({"v": [top]})

        rows = df.select(*[known(x).alias(f"x{i}") for i, x in enumerate(feats)])
        return rows.mapInPandas(moves, "v double").agg(F.max("v")).first()[0] < limit


def _solve(gram: np.ndarray, others: list[int], j: int, strength: float | None) -> tuple[np.ndarray, float]:
    """Ridge weights of column j on the others, from sums of products (row 0 holds plain sums)."""
    d = gram.shape[0] - 1
    n = gram[0, 0]
    pos = [i + 1 for i in others]
    mean_x, mean_y = gram[0, pos] / n, gram[0, j + 1] / n
    xx = gram[np.ix_(pos, pos)] - n * np.outer(mean_x, mean_x)
    xy = gram[pos, j + 1] - n * mean_x * mean_y
    yy = gram[j + 1, j + 1] - n * mean_y * mean_y
    if strength is not None:
        w = np.linalg.solve(xx + strength * np.eye(len(pos)), xy)
    else:
        w = _evidence_ridge(xx, xy, yy, n)
    coef = np.zeros(d)
    coef[others] = w
    return coef, float(mean_y - mean_x @ w)


def _evidence_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, rounds: int = 300) -> np.ndarray:
    """Noise and weight precision by evidence maximisation, weak gamma priors (1e-6)."""
    eig, vec = np.linalg.eigh(xx)
    eig = np.clip(eig, 0.0, None)
    proj = vec.T @ xy
    prior = 1e-6
    noise, weight = n / max(yy, 1e-300), 1.0
    w = np.zeros(len(xy))
    for _ in range(rounds):
        new = vec @ (proj / (eig + weight / noise))
        rss = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        free = float(np.sum(noise * eig / (weight + noise * eig)))
        weight = (free + 2 * prior) / (new @ new + 2 * prior)
        noise = (n - free + 2 * prior) / (rss + 2 * prior)
        if np.abs(new - w).sum() < 1e-3:
            w = new
            break
        w = new
    return vec @ (proj / (eig + weight / noise))


# ---- iterative trees -------------------------------------------------------


@dataclass
class IterativeModels:
    features: list[str]
    start: Constants
    models: list[tuple[str, object]]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        names = df.columns
        work = self.start.transform(df.withColumns({f"_g_{x}": F.col(x).isNull() for x in self.features}))
        for i, (target, model) in enumerate(self.models):
            if i and i % 12 == 0:
                work = cut(work)  # keeps the plan of a long round-robin short
            others = [x for x in self.features if x != target]
            ready = VectorAssembler(inputCols=others, outputCol="_vec").transform(work)
            scored = model.transform(ready)
            work = scored.withColumn(target, F.when(F.col(f"_g_{target}"), F.col("prediction")).otherwise(F.col(target)))
            work = work.drop("_vec", "prediction")
        return work.select(*names)


@dataclass
class TreeChain:
    """Start values and the ordered tree models that were fitted, replayed on rows as arrays."""

    features: list[str]
    start: Constants
    steps: list[tuple[int, gaptrees.GapTrees]]
    rounds: int

    def fill(self, x: np.ndarray, since: int = 0, until: int | None = None, gaps: np.ndarray | None = None) -> np.ndarray:
        """Rows (NaN is a gap) after the steps ``since`` to ``until``; ``gaps`` where ``x`` is filled already."""
        if gaps is None:
            gaps = np.isnan(x)
            x = np.where(gaps, np.array([self.start.values[f] for f in self.features]), x)
        else:
            x = x.copy()
        for j, model in self.steps[since:until]:
            hit = gaps[:, j]
            if hit.any():
                others = [i for i in range(len(self.features)) if i != j]
                x[hit, j] = model.value(model.bins(x[hit][:, others]))
        return x

    def filler(self, last: int) -> Callable[[np.ndarray], np.ndarray]:
        """:meth:`fill` with the steps so far for rows whose column ``last`` stands at the end."""
        now = TreeChain(self.features, self.start, list(self.steps), self.rounds)
        back = [*range(last), len(self.features) - 1, *range(last, len(self.features) - 1)]
        there = [*(i for i in range(len(self.features)) if i != last), last]
        return lambda x: now.fill(x[:, back])[:, there]

    def transform(self, df: DataFrame) -> DataFrame:
        """One pass over the rows whatever the number of steps."""
        feats, names = self.features, df.columns
        if not feats:
            return df

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            rows = np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), len(feats))
            return pd.Series(list(self.fill(rows)))

        filled = df.withColumn("_x", run(F.array(*[known(x) for x in feats])))
        return filled.select(*[F.col("_x")[feats.index(x)].alias(x) if x in feats else F.col(f"`{x}`") for x in names])


class IterativeTreesImputer:
    """Round-robin regression by boosted trees, or a ``forest`` (:mod:`gapweave.operators.gaptrees`), columns with few gaps first.

    A column's model is fitted on the rows that have it, the others filled by the models so far. Those are replayed on
    the rows as they are read, by the worker that puts them into bins, so the table is never written; a fit is one scan that reduces the rows to distinct bins.
    Rounds end when no filled value moves by ``tolerance`` of the largest absolute value. A column without any
    value stays as it is and takes no part; NaN is a gap.
    """

    def __init__(self, features: list[str], depth: int = 4, trees: int = 50, rounds: int = 10, tolerance: float = 1e-3, bins: int = 64, forest: bool = False, seed: int = 0):
        self.features, self.rounds, self.tolerance = features, rounds, tolerance
        self.settings, self.views = gaptrees.Settings(rounds=trees, depth=depth, loss="squared", bins=bins, by_rank=True), 1
        if forest:
            self.settings, self.views = gaptrees.forest(trees, depth, bins, seed)

    def fit(self, df: DataFrame) -> TreeChain:
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.avg(known(x)).alias(f"m_{x}") for x in self.features],
            *[F.count_if(known(x).isNull()).alias(f"n_{x}") for x in self.features],
            *[F.max(F.abs(known(x))).alias(f"a_{x}") for x in self.features],
        ).first()
        feats = [x for x in self.features if row[f"m_{x}"] is not None]
        chain = TreeChain(feats, Constants({x: row[f"m_{x}"] for x in feats}), [], 0)
        order = sorted((i for i, x in enumerate(feats) if row[f"n_{x}"]), key=lambda i: (row[f"n_{feats[i]}"], i))
        if not order or len(feats) < 2:
            return chain
        limit = self.tolerance * max(row[f"a_{x}"] for x in feats)
        edges = gaptrees.fit_edges(df, feats, self.settings)
        source = df.select(*[F.col(f"`{x}`") for x in feats])
        for chain.rounds in range(1, self.rounds + 1):
            before = len(chain.steps)
            for j in order:
                others = [x for x in feats if x != feats[j]]
                seen = source.filter(known(feats[j]).isNotNull())
                known_edges = [edges[feats.index(x)] for x in others]
                chain.steps.append((j, gaptrees.fit(seen, others, feats[j], [others] * self.views, self.settings, edges=known_edges, most_rows=row["rows"], fill=chain.filler(j))))
            if chain.rounds > 1 and self._largest_move(source, chain, before) < limit:
                break
        return chain

    def _largest_move(self, source: DataFrame, chain: TreeChain, before: int) -> float:
        def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = 0.0
            for pdf in batches:
                x = pdf.to_numpy(dtype=float)
                gaps = np.isnan(x)
                old = chain.fill(x, 0, before)
                new = chain.fill(old, before, None, gaps)
                top = max(top, float(np.abs(new - old).max(initial=0.0)))
            yield pd.DataFrame({"v": [top]})

        rows = source.select(*[known(x).alias(f"x{i}") for i, x in enumerate(chain.features)])
        return rows.mapInPandas(moves, "v double").agg(F.max("v")).first()[0]


class IterativeModelImputer:
    """Round-robin regression with any ``pyspark.ml`` regressor (boosted trees, forests)."""

    def __init__(self, features: list[str], make: Callable[[], object], rounds: int = 10, tolerance: float = 1e-3):
        self.features, self.make, self.rounds, self.tolerance = features, make, rounds, tolerance

    def fit(self, df: DataFrame) -> IterativeModels:
        from pyspark.ml.feature import VectorAssembler

        feats = self.features
        row = df.agg(
            *[F.avg(x).alias(f"m_{x}") for x in feats],
            *[F.count_if(F.col(x).isNull()).alias(f"n_{x}") for x in feats],
            *[F.max(F.abs(F.col(x))).alias(f"a_{x}") for x in feats],
        ).first()
        start = Constants({x: row[f"m_{x}"] for x in feats})
        order = sorted((x for x in feats if row[f"n_{x}"]), key=lambda x: (row[f"n_{x}"], feats.index(x)))
        limit = self.tolerance * max(row[f"a_{x}"] or 0.0 for x in feats)
        flags = df.select(*feats).withColumns({f"_g_{x}": F.col(x).isNull() for x in feats})
        work = cut(start.transform(flags))
        models: list[tuple[str, object]] = []
        for done in range(1, self.rounds + 1):
            previous = {x: F.col(x).alias(f"_old_{x}") for x in order}
            work = work.select(*[c for c in work.columns if not c.startswith("_old_")], *previous.values())
            for target in order:
                others = [x for x in feats if x != target]
                ready = VectorAssembler(inputCols=others, outputCol="_vec").transform(work)
                known = ready.filter(~F.col(f"_g_{target}"))
                est = self.make()
                est.setFeaturesCol("_vec").setLabelCol(target).setPredictionCol("_pred")
                model = est.fit(known)
                model.setPredictionCol("prediction")
                models.append((target, model))
                scored = model.transform(ready)
                fixed = F.when(F.col(f"_g_{target}"), F.col("prediction")).otherwise(F.col(target))
                work = cut(scored.withColumn(target, fixed).drop("_vec", "prediction"))
            if order:
                move = work.agg(
                    F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(x) - F.col(f"_old_{x}"))) for x in order])
                ).first()[0]
                if done > 1 and move < limit:
                    break
        return IterativeModels(feats, start, models)


def boosted_trees(depth: int = 4, trees: int = 50, seed: int = 0):
    from pyspark.ml.regression import GBTRegressor

    return lambda: GBTRegressor(maxDepth=depth, maxIter=trees, seed=seed)


def forest(depth: int = 4, trees: int = 50, seed: int = 0):
    from pyspark.ml.regression import RandomForestRegressor

    return lambda: RandomForestRegressor(maxDepth=depth, numTrees=trees, seed=seed)
