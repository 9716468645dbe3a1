"""Boosted trees that take gaps as they are, for many views of the columns at once.

Values are put into bins, a gap into a bin of its own. For every open leaf, counts and sums of first and second derivatives of the
loss are added up by column and bin; a split sends the gap bin to the side where it gains more, which is the default
direction of later rows. A view is a choice of columns: the rest are gaps to it in every row, so it never splits on them
and learns from all rows nevertheless. All views grow by one level in one pass.

Rows with the same bins stay together in every tree. So the table is first reduced to distinct bins with a count and the
sum of the target. What remains is worked on by the driver if it is small (``HELD`` bytes), else as a table: each
level is then a job that replays the trees so far on the bins, sums by leaf, and finds the splits where the sums meet;
only splits come back. Nothing is written between levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.operators.patterns import known
from gapweave.session import cut

GAP = 255
#: Bytes of distinct rows up to which the driver grows the trees itself.
HELD = 64 << 20


@dataclass
class Tree:
    """One tree for each view, as arrays by heap position; column -1 is no split, whose rows go left."""

    column: np.ndarray
    split: np.ndarray
    gap_left: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray, view: int, depth: int) -> np.ndarray:
        """Position of each row among the 2 ** depth of a level."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(depth):
            k = (1 << level) - 1 + at
            column = self.column[view, k]
            b = bins[rows, np.maximum(column, 0)]
            left = np.where(b == GAP, self.gap_left[view, k], b <= self.split[view, k]) | (column < 0)
            at = 2 * at + ~left
        return at


@dataclass
class Settings:
    """``rounds`` trees of ``depth``; ``bins`` (at most 254) of equal width, or of about equal counts with ``by_rank``."""

    rounds: int = 50
    depth: int = 4
    rate: float = 0.3
    ridge: float = 1.0
    least_rows: int = 1
    bins: int = 32
    by_rank: bool = False
    loss: str = "logistic"  # or "squared"
    bag: int | None = None  # a seed: each view learns from its own bootstrap of the distinct rows


def forest(trees: int = 50, depth: int = 4, bins: int = 64, seed: int = 0) -> tuple[Settings, int]:
    """Settings of a regression forest and its number of views: one bagged tree for each, all grown together."""
    return Settings(rounds=1, depth=depth, rate=1.0, ridge=0.0, bins=bins, by_rank=True, loss="squared", bag=seed), trees


@dataclass
class GapTrees:
    """Fitted trees, one sequence for each view."""

    features: list[str]
    views: np.ndarray  # (view, column): whether the view sees the column
    edges: list[np.ndarray]
    base: float
    settings: Settings
    trees: list[Tree]
    rows: int
    gains: list[dict[tuple[int, int], tuple]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return to_bins(x, self.edges)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """(row, view): sums of leaf values, replayed tree by tree."""
        out = np.full((len(bins), len(self.views)), self.base)
        for tree in self.trees:
            for view in range(len(self.views)):
                out[:, view] += tree.value[view, tree.leaf(bins, view, self.settings.depth)]
        return out

    def value(self, bins: np.ndarray) -> np.ndarray:
        """One number per row: the mean of a forest's trees, else the first view."""
        m = self.margins(bins)
        return m.mean(axis=1) if self.settings.bag is not None else m[:, 0]

    def predict(self) -> Column:
        """Array with the prediction of each view, a probability for the logistic loss."""

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = self.margins(self.bins(np.array([[np.nan if v is None else v for v in r] for r in x], float)))
            return pd.Series(list(_mean(m, self.settings.loss)))

        return run(F.array(*[known(x) for x in self.features]))


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds values above edge b - 1 up to edge b; gaps are ``GAP``."""
    out = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)
    out[np.isnan(x)] = GAP
    return out


def _mean(margin: np.ndarray, loss: str) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin)) if loss == "logistic" else margin


def fit_edges(df: DataFrame, features: list[str], settings: Settings) -> list[np.ndarray]:
    """Edges of each column's bins; one aggregate."""
    parts = settings.bins
    if settings.by_rank:
        shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
        row = df.agg(*[F.percentile_approx(known(x), shares, 10_000).alias(f"e{i}") for i, x in enumerate(features)]).first()
        return [np.unique(np.array(row[f"e{i}"] or [], float)) for i in range(len(features))]
    row = df.agg(*[f(known(x)).alias(f"{n}{i}") for i, x in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i in range(len(features)):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        out.append(np.array([]) if lo is None else lo + (hi - lo) * (np.arange(1, parts) / parts))
    return out


def binned(df: DataFrame, features: list[str], target: str, edges: list[np.ndarray], fill: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(bins, n, total): distinct bins of the rows with a target, how many they are, and the sum of the target.

    ``fill`` is applied to the features and the target of a block of rows, the target last, before they are put into
    bins, in the same worker; it leaves known targets as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))], axis=1)
            if fill is not None:
                x = fill(np.column_stack((x, batch.column(0).to_numpy(zero_copy_only=False))))[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array([bytes(r) for r in to_bins(x, edges)], pa.binary()), batch.column(0)], ["bins", "y"])

    rows = df.select(F.col(target).cast("double").alias("y"), *[known(x).alias(f"x{i}") for i, x in enumerate(features)]).filter("y IS NOT NULL")
    each = rows.mapInArrow(run, "bins binary, y double")
    return each.groupBy("bins").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("total"))


class _Rows:
    """Distinct rows in memory."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, width: int):
        raw = b"".join(batch.column("bins").to_pylist())
        self.bins = np.frombuffer(raw, np.uint8).reshape(batch.num_rows, width)
        self.n, self.total = batch.column("n").to_numpy(), batch.column("total").to_numpy()
        self._bags: dict[int, np.ndarray] = {}

    def _bag(self, view: int, seed: int) -> np.ndarray:
        """How often each distinct row is drawn by a view: Poisson with mean n, a hash of (bins, view, seed) decides."""
        if view not in self._bags:
            self._bags[view] = poisson(draws(self.bins, view, seed), self.n)
        return self._bags[view]

    def sums(self, model: GapTrees, margin: np.ndarray, tree: Tree, level: int) -> np.ndarray:
        """(view, leaf, column, bin, 3): rows, first and second derivatives; the last bin holds the gaps."""
        width, leaves = model.settings.bins + 1, 1 << level
        out = np.zeros((len(model.views), leaves, len(model.features), width, 3))
        place = np.where(self.bins == GAP, width - 1, self.bins).astype(np.int64)
        for view, sees in enumerate(model.views):
            mean = _mean(margin[:, view], model.settings.loss)
            curve = mean * (1 - mean) if model.settings.loss == "logistic" else np.ones(len(mean))
            part = self._bag(view, model.settings.bag) / self.n if model.settings.bag is not None else 1.0
            weights = (part * self.n, part * (self.n * mean - self.total), part * self.n * curve)
            leaf = tree.leaf(self.bins, view, level)
            for column in range(len(model.features)):
                # a column that the view does not see is one gap
                cell = leaf * width + (place[:, column] if sees[column] else width - 1)
                for k, w in enumerate(weights):
                    out[view, :, column, :, k] = np.bincount(cell, w, leaves * width).reshape(leaves, width)
        return out


def draws(bins: np.ndarray, view: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row of bins, the same wherever it is made."""
    with np.errstate(over="ignore"):
        h = np.full(len(bins), (view * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F + 1) % (1 << 64), np.uint64)
        for k in range(bins.shape[1]):
            h = (h ^ (bins[:, k].astype(np.uint64) + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson counts by inversion of uniform numbers; a rounded normal from a mean of 50 on."""
    from statistics import NormalDist

    out, small = np.zeros(len(u)), mean < 50
    m, left = mean[small], u[small].copy()
    p, count, open_ = np.exp(-m), np.zeros(len(m)), np.ones(len(m), bool)
    k = 0
    while open_.any() and k < 400:
        open_ &= left > p
        count += open_
        left -= np.where(open_, p, 0.0)
        k += 1
        p = p * m / k
    out[small] = count
    normal = NormalDist()
    out[~small] = np.maximum(0.0, np.round([b + b**0.5 * normal.inv_cdf(a) for a, b in zip(u[~small], mean[~small], strict=True)]))
    return out


def best_split(sums: np.ndarray, settings: Settings) -> tuple[float, int, int, bool, np.ndarray, np.ndarray] | None:
    """(gain, column, last bin on the left, gaps left, sums left, sums right) for one leaf's (column, bin, 3).

    Equal gains (to nine digits): the first column, the first bin, gaps left. A split of known values against
    gaps counts as the last bin with gaps right. None without a gain or enough rows on both sides.
    """
    inside = np.cumsum(sums[:, :-1], axis=1)
    gaps = sums[:, -1:]
    whole = inside[:, -1:] + gaps
    left = np.stack([inside + gaps, inside], axis=2)  # (column, bin, gaps left or right, 3)
    right = whole[:, :, None, :] - left

    def score(x: np.ndarray) -> np.ndarray:
        return x[..., 1] ** 2 / (x[..., 2] + settings.ridge)

    with np.errstate(divide="ignore", invalid="ignore"):  # empty sides, which are left out below
        gain = np.round(score(left) + score(right) - score(whole)[:, :, None], 9)
    enough = (left[..., 0] >= settings.least_rows) & (right[..., 0] >= settings.least_rows)
    gain = np.where(enough, gain, -np.inf)
    best = int(np.argmax(gain))
    column, at, side = np.unravel_index(best, gain.shape)
    if not gain[column, at, side] > 0:
        return None
    return float(gain[column, at, side]), int(column), int(at), side == 0, left[column, at, side], right[column, at, side]


def _splits(table: DataFrame, model: GapTrees, tree: Tree, level: int) -> dict[tuple[int, int], tuple]:
    """Best split of each open leaf, found by Spark; leaves without rows are left out."""
    settings, width, columns = model.settings, model.settings.bins + 1, len(model.features)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = _Rows(batch, columns)
            part = rows.sums(model, model.margins(rows.bins), tree, level)
            total = part if total is None else total + part
        if total is not None:
            view, leaf = np.nonzero(total[:, :, 0, :, 0].sum(axis=2))
            raw = [total[v, k].tobytes() for v, k in zip(view, leaf, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(leaf), pa.array(raw, pa.binary())], ["view", "leaf", "sums"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def row() -> pa.RecordBatch:
            found = best_split(total, settings)
            whole = total[0].sum(axis=0)
            gain, column, at, left, a, b = found or (0.0, -1, -1, True, whole, np.zeros(3))
            values = [now[0], now[1], gain, column, at, bool(left), [float(v) for v in a], [float(v) for v in b]]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["view", "leaf", "gain", "col", "at", "gap_left", "a", "b"])

        for batch in batches:
            for view, leaf, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                part = np.frombuffer(raw).reshape(columns, width, 3)
                if (view, leaf) == now:
                    total = total + part
                    continue
                if now is not None:
                    yield row()
                now, total = (view, leaf), part
        if now is not None:
            yield row()

    partial = table.mapInArrow(add, "view long, leaf long, sums binary")
    met = partial.repartition("view", "leaf").sortWithinPartitions("view", "leaf", "sums")
    found = met.mapInArrow(settle, "view long, leaf long, gain double, col long, at long, gap_left boolean, a array<double>, b array<double>")
    return {(r["view"], r["leaf"]): (r["gain"], r["col"], r["at"], r["gap_left"], np.array(r["a"]), np.array(r["b"])) for r in found.collect()}


def fit(
    df: DataFrame,
    features: list[str],
    target: str,
    views: list[list[str]],
    settings: Settings | None = None,
    held: int = HELD,
    edges: list[np.ndarray] | None = None,
    most_rows: int | None = None,
    *,
    fill: Callable[[np.ndarray], np.ndarray] | None = None,
) -> GapTrees:
    """Trees for each view (a list of columns it sees), all on all rows with a target.

    ``edges`` saves the scan that finds them. Where ``df`` is known to have at most ``most_rows`` rows and those fit, the
    distinct rows come to the driver in one job and nothing is written. ``fill`` is as in :func:`binned`.

    Without rows the base is 0 and there are no trees. A column without values is a gap everywhere. The result does not
    depend on where the work is done, nor on the order of the rows, up to rounding of sums.
    """
    settings = settings or Settings()
    if not 2 <= settings.bins <= 254:
        raise ValueError("2 to 254 bins")
    edges = fit_edges(df, features, settings) if edges is None else edges
    table, local = binned(df, features, target, edges, fill), None
    row_bytes = len(features) + 16 + 8 * len(views)
    if most_rows is not None and most_rows * row_bytes <= held:
        local = _Rows(table.toArrow().sort_by("bins"), len(features))
        n, total = float(local.n.sum()), float(local.total.sum())
    else:
        table = cut(table)
        cells, n, total = table.agg(F.count(F.lit(1)), F.sum("n"), F.sum("total")).first()
        if n and cells * row_bytes <= held:
            local = _Rows(table.toArrow().sort_by("bins"), len(features))
    sees = np.array([[x in view for x in features] for view in views], bool).reshape(len(views), len(features))
    model = GapTrees(features, sees, edges, 0.0, settings, [], int(n or 0), [])
    if not n:
        return model
    mean = total / n
    if settings.loss == "logistic":
        mean = min(max(mean, 1e-9), 1 - 1e-9)
        model.base = float(np.log(mean / (1 - mean)))
    else:
        model.base = float(mean)
    margin = model.margins(local.bins) if local else None
    m, depth = len(views), settings.depth
    for _ in range(settings.rounds):
        inner, leaves = (1 << depth) - 1, 1 << depth
        tree = Tree(np.full((m, inner), -1, np.int64), np.zeros((m, inner), np.int64), np.ones((m, inner), bool), np.zeros((m, leaves)))
        sums = {}
        gains: dict[tuple[int, int], tuple] = {}
        for level in range(depth):
            if local:
                every = local.sums(model, margin, tree, level)
                found = {}
                for view in range(m):
                    for leaf in range(1 << level):
                        whole = every[view, leaf, 0].sum(axis=0)
                        if whole[0]:
                            found[view, leaf] = best_split(every[view, leaf], settings) or (0.0, -1, -1, True, whole, np.zeros(3))
            else:
                found = _splits(table, model, tree, level)
            sums = {}
            for (view, leaf), (gain, column, at, left, a, b) in found.items():
                k = (1 << level) - 1 + leaf
                tree.column[view, k], tree.split[view, k], tree.gap_left[view, k] = column, at, left
                gains[view, k] = (gain, column, at, left, a, b)
                sums[view, 2 * leaf], sums[view, 2 * leaf + 1] = a, b
        for (view, leaf), x in sums.items():
            if x[0]:
                tree.value[view, leaf] = -settings.rate * x[1] / (x[2] + settings.ridge)
        model.trees.append(tree)
        model.gains.append(gains)
        if local:
            for view in range(m):
                margin[:, view] += tree.value[view, tree.leaf(local.bins, view, depth)]
        if (tree.column < 0).all():
            break  # no view splits any more
    return model
