"""Impute-then-predict members, pools, stacking, calibration and boosting on ``pyspark.ml``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.draw import draw
from gapweave.functions.scalar import sigmoid, threshold_label
from gapweave.operators import gaptrees, impute
from gapweave.operators.blend import PoolMember
from gapweave.operators.patterns import known
from gapweave.operators.threshold import best_threshold, threshold_sweep
from gapweave.session import cut

Factory = Callable[[], object]


def score_column(scored: DataFrame) -> Column:
    """Probability of class 1 of a classifier, prediction of a regressor."""
    return vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")


@dataclass
class ImputedModel:
    """An imputer and an estimator used as one.

    ``threshold`` is 0.5 unless tuned. :meth:`imputed` gives the filled table,
    which is needed again for imputation errors and neighbour searches.
    """

    imputer: object
    make: Factory
    features: list[str]
    target: str
    id_col: str = "row_id"
    threshold: float = 0.5
    filler: object = None
    model: object = None

    def fit(self, train: DataFrame) -> ImputedModel:
        self.filler = self.imputer.fit(train)
        est = self.make()
        est.setFeaturesCol("_vec").setLabelCol(self.target)
        stages = [VectorAssembler(inputCols=self.features, outputCol="_vec"), est]
        self.model = Pipeline(stages=stages).fit(self.imputed(train).select(self.target, *self.features))
        return self

    def imputed(self, df: DataFrame) -> DataFrame:
        if isinstance(self.filler, impute.KnnFill):
            return self.filler.transform(df, self.id_col)
        return self.filler.transform(df)

    def predict(self, df: DataFrame, filled: bool = False) -> DataFrame:
        """Adds ``p`` (probability or prediction) to the imputed table."""
        ready = df if filled else self.imputed(df)
        scored = self.model.transform(ready)
        return scored.select(*ready.columns, score_column(scored).alias("p"))

    def labels(self, df: DataFrame) -> DataFrame:
        return self.predict(df).withColumn("label", threshold_label("p", self.threshold))

    def tune_threshold(self, val: DataFrame, step: float = 0.1) -> float:
        preds = self.predict(val).select(F.col(self.target).alias("y"), "p").withColumn("_k", F.lit(0))
        row = best_threshold(threshold_sweep(preds, ["_k"], step=step), ["_k"], step).first()
        self.threshold = row["threshold"]
        return self.threshold


def classifier_pool(
    features: list[str], target: str, id_col: str = "row_id", depth: int = 4, trees: int = 50, rounds: int = 10,
    seed: int = 0, large: bool = False,
) -> dict[str, ImputedModel]:
    """The study's pool: forest x {iterative boosted, k-NN}; ``large`` adds boosted trees and two more imputers."""
    imputers = {
        "iter_boosted": lambda: impute.IterativeTreesImputer(features, depth, trees, rounds),
        "knn": lambda: impute.KnnImputer(features, id_col),
    }
    models: dict[str, Factory] = {"forest": lambda: RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=seed)}
    if large:
        imputers["iter_ridge"] = lambda: impute.IterativeRidgeImputer(features, rounds)
        imputers["iter_forest"] = lambda: impute.IterativeTreesImputer(features, depth, trees, rounds, forest=True, seed=seed)
        models["boosted"] = lambda: GBTClassifier(maxDepth=depth, maxIter=trees, seed=seed)
    return cross(models, imputers, features, target, id_col)


def regressor_pool(
    features: list[str], target: str, id_col: str = "row_id", depth: int = 4, trees: int = 50, rounds: int = 10, seed: int = 0
) -> dict[str, ImputedModel]:
    """{boosted, forest} x {iterative ridge, iterative boosted, iterative forest, k-NN}."""
    imputers = {
        "iter_ridge": lambda: impute.IterativeRidgeImputer(features, rounds),
        "iter_boosted": lambda: impute.IterativeTreesImputer(features, depth, trees, rounds),
        "iter_forest": lambda: impute.IterativeTreesImputer(features, depth, trees, rounds, forest=True, seed=seed),
        "knn": lambda: impute.KnnImputer(features, id_col),
    }
    models: dict[str, Factory] = {
        "boosted": lambda: GBTRegressor(maxDepth=depth, maxIter=trees, seed=seed),
        "forest": lambda: RandomForestRegressor(maxDepth=depth, numTrees=trees, seed=seed),
    }
    return cross(models, imputers, features, target, id_col)


def cross(models: dict[str, Factory], imputers: dict[str, Factory], features, target, id_col) -> dict[str, ImputedModel]:
    return {
        f"{m}+{i}": ImputedModel(make_imputer(), make, features, target, id_col)
        for m, make in models.items()
        for i, make_imputer in imputers.items()
    }


def fit_pool(pool: dict[str, ImputedModel], train: DataFrame, parallel: int = 2) -> dict[str, ImputedModel]:
    """Fit members side by side; each fit is a chain of Spark jobs, the threads only submit them."""
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
        list(ex.map(lambda m: m.fit(train), pool.values()))
    return pool


def pool_views(pool: dict[str, ImputedModel], val: DataFrame, test: DataFrame) -> list[PoolMember]:
    """Imputed features and predictions of each member, written once for the steps that follow."""
    out = []
    for name, m in pool.items():
        keep = [m.id_col, *m.features, F.col(m.target).cast("double").alias("y"), "p"]
        v = cut(m.predict(val).select(*keep))
        t = cut(m.predict(test).select(*keep))
        out.append(PoolMember(name, v, t))
    return out


def long_predictions(views: list[PoolMember], side: str, id_col: str = "row_id") -> DataFrame:
    parts = [
        getattr(v, side).select(id_col, F.lit(i).alias("idx"), F.lit(v.name).alias("model"), "y", "p")
        for i, v in enumerate(views)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- stacking --------------------------------------------------------------


@dataclass
class Stack:
    """Boosted trees on the outputs of a fitted pool for validation rows."""

    members: list[str]
    settings: gaptrees.Settings
    model: gaptrees.GapTrees | None = None

    @property
    def inputs(self) -> list[str]:
        return [f"p_{i}" for i in range(len(self.members))]

    def _wide(self, preds: DataFrame, id_col: str) -> DataFrame:
        w = preds.groupBy(id_col).pivot("idx", list(range(len(self.members)))).agg(F.first("p"))
        return w.select(id_col, *[F.col(str(i)).alias(f"p_{i}") for i in range(len(self.members))])

    def fit(self, val_preds: DataFrame, id_col: str = "row_id") -> Stack:
        y = val_preds.groupBy(id_col).agg(F.first("y").alias("y"))
        wide = cut(self._wide(val_preds, id_col).join(y, id_col))
        self.model = gaptrees.fit(wide, self.inputs, "y", [self.inputs], self.settings)
        return self

    def predict(self, test_preds: DataFrame, id_col: str = "row_id") -> DataFrame:
        return self._wide(test_preds, id_col).select(id_col, self.model.predict()[0].alias("blend"))


def stack_classifier(members: list[str], depth: int = 3, trees: int = 60) -> Stack:
    return Stack(members, gaptrees.Settings(rounds=trees, depth=depth))


def stack_regressor(members: list[str], depth: int = 3, trees: int = 60) -> Stack:
    return Stack(members, gaptrees.Settings(rounds=trees, depth=depth, loss="squared"))


# ---- calibration -----------------------------------------------------------


@dataclass
class Platt:
    """Logistic curve on a raw score, fitted on rows the scorer has not seen (Platt 1999).

    Targets are smoothed by the class counts. Two numbers are sought, so each
    Newton step needs six sums: one aggregate, whatever the size of the table.
    """

    slope: float = 0.0
    intercept: float = 0.0

    def fit(self, held_out: DataFrame, p: str = "p", y: str = "y", steps: int = 50) -> Platt:
        df = cut(held_out.select(F.col(p).cast("double").alias("f"), (F.col(y) == 1).alias("pos")))
        n = df.agg(F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg")).first()
        high, low = (n["pos"] + 1.0) / (n["pos"] + 2.0), 1.0 / (n["neg"] + 2.0)
        goal = F.when(F.col("pos"), high).otherwise(low)
        w, b = 0.0, math.log((n["pos"] + 1.0) / (n["neg"] + 1.0))
        best, step = math.inf, (0.0, 0.0)
        for _ in range(steps):
            z = F.col("f") * F.lit(w) + F.lit(b)
            q = sigmoid(z)
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - goal * z
            h, r, f = q * (1.0 - q), q - goal, F.col("f")
            s = df.agg(
                F.sum(loss).alias("loss"), F.sum(r * f).alias("gw"), F.sum(r).alias("gb"),
                F.sum(h * f * f).alias("hww"), F.sum(h * f).alias("hwb"), F.sum(h).alias("hbb"),
            ).first()
            if s["loss"] > best + 1e-9 * abs(best):
                step = (step[0] / 2, step[1] / 2)  # overshot: go half the way back
                w, b = w + step[0], b + step[1]
                continue
            best = s["loss"]
            det = s["hww"] * s["hbb"] - s["hwb"] ** 2
            if det <= 0:
                break
            dw = (s["gw"] * s["hbb"] - s["gb"] * s["hwb"]) / det
            db = (s["gb"] * s["hww"] - s["gw"] * s["hwb"]) / det
            w, b, step = w - dw, b - db, (dw, db)
            if max(abs(dw), abs(db)) < 1e-9:
                break
        self.slope, self.intercept = w, b
        return self

    def predict(self, df: DataFrame, p: str = "p", out: str = "calibrated") -> DataFrame:
        return df.withColumn(out, sigmoid(F.col(p) * F.lit(self.slope) + F.lit(self.intercept)))


def platt_cross_fit(df: DataFrame, member: Callable[[], ImputedModel], id_col: str, y: str, k: int = 5, seed: int = 42) -> Platt:
    """Scores from k held-out parts feed one curve."""
    part = F.floor(draw(id_col, "platt", seed) * k).cast("int")
    keyed = df.withColumn("_part", part)
    held = None
    for i in range(k):
        m = member().fit(keyed.filter(F.col("_part") != i).drop("_part"))
        p = m.predict(keyed.filter(F.col("_part") == i).drop("_part")).select(id_col, F.col(y).alias("y"), "p")
        held = p if held is None else held.unionByName(p)
    return Platt().fit(cut(held))


# ---- boosting --------------------------------------------------------------


@dataclass
class Stump:
    """Votes -1 or 1 on both sides of an edge of one column."""

    column: int
    split: int
    edge: float
    left: int
    right: int

    def votes(self, bins: np.ndarray) -> np.ndarray:
        return np.where(bins[:, self.column] <= self.split, self.left, self.right)


@dataclass
class StumpBoost:
    """Boosted stumps with labels -1 / 1; gaps count as 0.

    ``shift_bias`` re-balances the classes' weights after each round.
    ``gap_aware`` lowers a stump's vote on rows where features are missing,
    by the share of the other stumps' strengths; stump m is paired with
    feature m, so it needs at least as many features as stumps.

    Rows of equal bins and label always have equal weights, so the table is reduced to distinct bins with the rows
    of each label. A round needs the weights added up by column and bin: on the driver where the distinct rows fit in
    ``held`` bytes, else in one job that replays the votes so far. No weights are written.
    """

    features: list[str]
    target: str
    rounds: int = 50
    shift_bias: bool = True
    gap_aware: bool = True
    bins: int = 128
    by_rank: bool = True
    held: int = gaptrees.HELD
    models: list[Stump] = field(default_factory=list)
    betas: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    factors: list[dict[tuple[int, int], float]] = field(default_factory=list)  # (label, vote): what a round multiplies

    def fit(self, df: DataFrame) -> StumpBoost:
        if self.gap_aware and self.rounds > len(self.features):
            raise ValueError("gap-aware voting pairs stumps with features: rounds must not exceed their number")
        self.models, self.betas, self.errors, self.factors = [], [], [], []
        filled = df.select(*[F.coalesce(known(x), F.lit(0.0)).alias(x) for x in self.features], F.col(self.target).cast("double").alias("_y"))
        edges = gaptrees.fit_edges(filled, self.features, gaptrees.Settings(bins=self.bins, by_rank=self.by_rank))
        cells = cut(gaptrees.binned(filled, self.features, "_y", edges))
        count, n = cells.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            return self
        local = _Cells(cells.toArrow(), len(self.features)) if count * (len(self.features) + 16) <= self.held else None
        for _ in range(self.rounds):
            sums = local.sums(self, n) if local else self._sums(cells, n)
            stump, (lp, ln, rp, rn) = best_stump(sums, edges)
            whole = lp + ln + rp + rn
            right = (lp if stump.left == 1 else ln) + (rp if stump.right == 1 else rn)
            error = (whole - right) / whole
            if error <= 1e-12 or error >= 1.0 - 1e-12:
                break  # nothing changes any more: the next stump would be the same
            alpha = 0.5 * math.log((1.0 - error) / error)
            # weights by (label, vote) after the update
            by = {(1, 1): 0.0, (1, -1): 0.0, (-1, 1): 0.0, (-1, -1): 0.0}
            for vote, pos, neg in ((stump.left, lp, ln), (stump.right, rp, rn)):
                by[1, vote] += pos * math.exp(-alpha * vote)
                by[-1, vote] += neg * math.exp(alpha * vote)
            shift = 0.5 * math.log(by[1, 1] / by[-1, -1]) if self.shift_bias and by[1, 1] and by[-1, -1] else 0.0
            bias = {1: math.exp(-shift), -1: math.exp(shift)}
            total = sum(w * bias[y] for (y, _), w in by.items())
            self.factors.append({(y, h): math.exp(-alpha * y * h) * bias[y] / total for y, h in by})
            self.models.append(stump)
            self.betas.append(alpha)
            self.errors.append(error)
        return self

    def weights(self, bins: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
        """Weight of one row of label 1, and of one of label -1, replayed from the votes."""
        pos, neg = np.full(len(bins), 1.0 / n), np.full(len(bins), 1.0 / n)
        for stump, factor in zip(self.models, self.factors, strict=True):
            up = stump.votes(bins) == 1
            pos *= np.where(up, factor[1, 1], factor[1, -1])
            neg *= np.where(up, factor[-1, 1], factor[-1, -1])
        return pos, neg

    def _sums(self, cells: DataFrame, n: float) -> np.ndarray:
        columns, boost = len(self.features), self

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((columns, 256, 2))
            for batch in batches:
                total += _Cells(batch, columns).sums(boost, n)
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["i", "v"])

        out = np.zeros(columns * 512)
        for r in cells.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # columns x bins numbers
            out[r["i"]] = r["v"]
        return out.reshape(columns, 256, 2)

    def predict(self, df: DataFrame, id_col: str = "row_id") -> DataFrame:
        """(id, score, label): sign of the weighted vote, as one projection."""
        gap = [known(x).isNull().cast("double") for x in self.features]
        score = F.lit(-float(sum(self.betas))) if self.gap_aware else F.lit(0.0)
        for m, s in enumerate(self.models):
            value = F.coalesce(known(self.features[s.column]), F.lit(0.0))
            vote = F.when(value <= F.lit(s.edge), float(s.left)).otherwise(float(s.right))
            weight = F.lit(float(self.betas[m]))
            if self.gap_aware:
                weight = F.lit(1.0)
                for j, b in enumerate(self.betas):
                    if j != m:
                        weight = weight - F.lit(b / self.betas[m]) * gap[j]
            score = score + weight * vote
        return df.select(id_col, score.alias("score")).withColumn("label", F.signum("score").cast("int"))


class _Cells:
    """Distinct bins with the rows of both labels."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, columns: int):
        self.bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, columns)
        n, total = batch.column("n").to_numpy(), batch.column("total").to_numpy()
        self.pos, self.neg = (n + total) / 2, (n - total) / 2

    def sums(self, boost: StumpBoost, n: float) -> np.ndarray:
        """(column, bin, label 1 or -1): weights added up."""
        pos, neg = boost.weights(self.bins, n)
        out = np.zeros((self.bins.shape[1], 256, 2))
        for column in range(self.bins.shape[1]):
            for k, w in enumerate((self.pos * pos, self.neg * neg)):
                out[column, :, k] = np.bincount(self.bins[:, column], w, 256)
        return out


def best_stump(sums: np.ndarray, edges: list[np.ndarray]) -> tuple[Stump, tuple[float, float, float, float]]:
    """The split of least Gini impurity and its weights (left 1, left -1, right 1, right -1).

    Equal ones (to twelve digits): the first column, the first edge. Without a split that parts the rows, one vote for all.
    """
    best, found = None, (0, len(edges[0]) if edges else 0, math.inf)
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:, :]
    for column, edge in enumerate(edges):
        a = left[column, : len(edge)]
        b = whole[column] - a
        wa, wb = a.sum(axis=1), b.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = 2 * a[:, 0] * a[:, 1] / wa + 2 * b[:, 0] * b[:, 1] / wb
        impurity = np.round(np.where((wa > 0) & (wb > 1e-15), impurity, np.inf), 12)
        if len(impurity) and (best is None or impurity.min() < best):
            at = int(np.argmin(impurity))
            if np.isfinite(impurity[at]):
                best, found = impurity[at], (column, at, float(edge[at]))
    column, at, edge = found
    a = left[column, at] if best is not None else whole[0, 0]
    b = whole[column, 0] - a if best is not None else np.zeros(2)
    votes = [1 if x[0] > x[1] else -1 for x in (a, b)]
    return Stump(column, at if best is not None else 255, edge, votes[0], votes[1]), (a[0], a[1], b[0], b[1])


def reweigh(scored: DataFrame, alpha: float, w: str = "_w", y: str = "_y", h: str = "_h") -> DataFrame:
    """One boosting update: w * exp(-alpha * y * h)."""
    return scored.withColumn(w, F.col(w) * F.exp(-F.lit(alpha) * F.col(y) * F.col(h)))


def adaboost(features: list[str], target: str, rounds: int = 100) -> StumpBoost:
    """Plain boosting of stumps."""
    return StumpBoost(features, target, rounds, shift_bias=False, gap_aware=False)


def constant_classifier(df: DataFrame, c: float = 0.5) -> DataFrame:
    return df.withColumn("p", F.lit(float(c)))
