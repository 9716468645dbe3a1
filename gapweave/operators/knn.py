"""Exact k-nearest-neighbour join.

Two physical forms with equal results:

* the reference side is proven small (its rows are counted against a bound
  first): every task searches it, broadcast as a matrix, for its queries;
* otherwise both sides are split into cells around pivots. A query first searches
  the cell of its nearest pivot, which bounds its k-th distance; the triangle
  inequality and the ranges of the cells then rule out cells that lie farther away, so
  a query visits few. Cells are cut into chunks of bounded size, which keeps a dense
  cell out of one task.

Inside a task, rows of few coordinates are searched by a balanced tree of boxes
(:class:`_Boxes`), so a query looks at few of them; rows of many coordinates, where
boxes rule out little, are filtered by matrix products and compared exactly after.

With gaps the distance is Euclidean on the coordinates that two rows share, and
which those are depends on both. A query and the reference rows that share the same
coordinates with it are an ordinary search on those coordinates: each pair of a query's
pattern and a shared set is a view with cells of its own, and the k best over a query's views are
its neighbours. Where there are too many patterns for that, cells hold rows of one pattern of gaps
where that has a pivot; each keeps the range of every coordinate, the coordinates
that all its rows have, and k of its rows. The k-th distance to all kept rows is a
query's bound, whatever their patterns; a cell is ruled out if even the least
mean gap to its ranges, over all sets of coordinates that one of its
rows may share with the query, is beyond it.

Only the k best of a block leave it; pairs are never shuffled. Ties are
resolved by (distance, id). Distances are rounded to 9 places before they are
compared, so that the order does not depend on summation order.

Copies on the reference side: of equal vectors only the k lowest ids can be
neighbours of anything, so the others are dropped first (exact).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapweave.functions.draw import draw_fast
from gapweave.session import cut, shuffle_width

BROADCAST_CELLS = 4_000_000  # rows x features of the reference side (32 MB of doubles)
MAX_PIVOTS = 4096
CHUNK_ROWS = 20_000
PAIR_BLOCK = 2_000_000  # distances held at once in a task
DIGITS = 9
CELL_ROWS = 10_000  # reference rows that a cell should hold, where boxes search it
WIDE = 8  # more coordinates are compared by matrix products
LEAF_ROWS = 16
QUERIES_AT_ONCE = 512
BOX_PAIRS = 500_000  # queries x boxes or points looked at together
MAX_PATTERNS = 16  # patterns of gaps of either side that are searched view by view
MAX_VIEWS = 64
WIDE_PARTS = 8  # cells of rows of many coordinates, at least
TILE = (512, 4096)  # queries x rows of one matrix product
MANY = 32  # pairs for each wanted one that a tile may leave to be compared
LARGE = 1e15  # from here on squares may leave single precision


def knn_join(
    queries: DataFrame,
    reference: DataFrame,
    features: list[str],
    k: int,
    query_id: str = "row_id",
    ref_id: str = "row_id",
    carry: list[str] | None = None,
    payload: list[str] | None = None,
    nan_aware: bool = False,
    max_cells: int = BROADCAST_CELLS,
    pivots: int | None = None,
) -> DataFrame:
    """(query id, *carry, rank, val_id, *payload, dist): the k nearest reference rows of each query.

    ``carry`` columns travel with the query and ``payload`` columns (numbers)
    with the reference row, which saves joining them back afterwards; the
    reference id is a long. With ``nan_aware`` the distance uses the
    coordinates present on both sides and is scaled to full width; rows
    without a shared coordinate are no neighbours.
    """
    carry, payload = list(carry or []), list(payload or [])
    shape = _Shape(len(features), len(payload), carry, k, nan_aware)
    q = queries.select(F.col(query_id).alias("_q"), *_numbers(features, "_x"), *carry)
    v = reference.select(F.col(ref_id).cast("long").alias("_v"), *_numbers(features, "_x"), *_numbers(payload, "_p"))
    n = v.count()
    if n * max(len(features) + len(payload), 1) <= max_cells:
        pairs = _broadcast_form(q, v.toPandas(), shape)
    else:
        pairs = _chunked_form(q, v, shape, pivots, n)
    return pairs.select(
        F.col("_q").alias(query_id),
        *carry,
        "rank",
        F.col("_v").alias("val_id"),
        *[F.col(f"_p{i}").alias(p) for i, p in enumerate(payload)],
        "dist",
    )


@dataclass(frozen=True)
class _Shape:
    width: int
    n_pay: int
    carry: list[str]
    k: int
    nan_aware: bool
    chunk: int = 0  # 0: CHUNK_ROWS

    @property
    def xs(self) -> list[str]:
        return [f"_x{i}" for i in range(self.width)]

    @property
    def ps(self) -> list[str]:
        return [f"_p{i}" for i in range(self.n_pay)]

    def out(self, q: DataFrame) -> str:
        types = {f.name: f.dataType.simpleString() for f in q.schema}
        extra = "".join(f", {name} {types[name]}" for name in self.carry)
        pay = "".join(f", {p} double" for p in self.ps)
        return f"_q {types['_q']}{extra}, rank int, _v bigint, dist double{pay}"

    @property
    def names(self) -> list[str]:
        return ["_q", *self.carry, "rank", "_v", "dist", *self.ps]


def _numbers(names: list[str], prefix: str):
    return [F.col(n).cast("double").alias(f"{prefix}{i}") for i, n in enumerate(names)]


def _squares(a: np.ndarray, b: np.ndarray, nan_aware: bool) -> np.ndarray:
    """Squared distances from plain differences, feature by feature, in the order SQL would add them."""
    total = np.zeros((len(a), len(b)))
    if not nan_aware:
        for j in range(a.shape[1]):
            d = a[:, j, None] - b[None, :, j]
            d *= d
            total += d
        return total
    present = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        ok = ~np.isnan(d)
        total += np.where(ok, d * d, 0.0)
        present += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        out = total * a.shape[1] / present
    return np.where(present > 0, out, np.inf)


def _best(square: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, rounded distance) of the k best per row; positions are in id order.

    Rounding keeps order, so the k-th rounded distance comes from the k-th
    square. All entries that may round to it are looked at, which keeps ties;
    they are then cut by (rounded distance, position).
    """
    if square.shape[1] > k:
        kth = np.partition(square, k - 1, axis=1)[:, k - 1]
        limit = np.where(np.isinf(kth), kth, (np.sqrt(kth) + 2 * 10.0**-DIGITS) ** 2)
        rows, pos = np.nonzero((square <= limit[:, None]) & np.isfinite(square))
    else:
        rows, pos = np.nonzero(np.isfinite(square))
    dist = np.round(np.sqrt(square[rows, pos]), DIGITS)
    order = np.lexsort((pos, dist, rows))
    rows, pos, dist = rows[order], pos[order], dist[order]
    starts = np.searchsorted(rows, np.arange(len(square)))
    rank = np.arange(len(rows)) - starts[rows]
    keep = rank < k
    return rows[keep], pos[keep], dist[keep]


def _nearest_of(rows: np.ndarray, pos: np.ndarray, square: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, rounded distance) of the k best per row among some pairs."""
    dist = np.round(np.sqrt(square * factor), DIGITS)
    return _first(rows, pos, dist, k)


def _first(rows: np.ndarray, pos: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pos, dist, rows))
    rows, pos, dist = rows[order], pos[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], pos[keep], dist[keep]


def _limit(kth: np.ndarray, factor: float) -> np.ndarray:
    """Squares up to which a row may be among the k best after rounding, from the k-th square."""
    return _loose(np.sqrt(kth * factor)) ** 2 / factor * (1 + 1e-12)


def _up_to_kth(rows: np.ndarray, square: np.ndarray, k: int, factor: float) -> np.ndarray:
    """Positions of the pairs that may be among the k best of their row; ``rows`` ascend."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(rows), 1), bool), rows[1:] != rows[:-1])))
    count = np.diff(np.append(first, len(rows)))
    limit = np.full(len(first), np.inf)
    size = np.ceil(np.log2(np.maximum(count, 1))).astype(int)
    for s in np.unique(size[count > k]):  # rows of about as many pairs at once
        some = np.flatnonzero((size == s) & (count > k))
        place = first[some, None] + np.arange(count[some].max())
        short = place >= (first + count)[some, None]
        table = square.take(np.where(short, 0, place))
        table[short] = np.inf
        limit[some] = _limit(np.partition(table, k - 1, axis=1)[:, k - 1], factor)
    return np.flatnonzero(square <= np.repeat(limit, count))


class _Boxes:
    """Balanced tree over distinct points: halves along the widest coordinate down to leaves of a few points, all in arrays.

    A box's least square to a query is added up in the order of the coordinates like a point's, so rounding never puts a
    point before its box. Of equal points only the k first can be neighbours; the others are left out.
    """

    def __init__(self, x: np.ndarray, k: int):
        order = np.lexsort(x.T[::-1]) if len(x) else np.zeros(0, np.int64)  # stable: equal points stay in id order
        same = np.concatenate(([False], (x[order[1:]] == x[order[:-1]]).all(axis=1))) if len(x) else np.zeros(0, bool)
        nth = np.arange(len(x)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(x)))) if len(x) else same
        order = order[nth < k]
        n, least = len(order), max(LEAF_ROWS, 2 * k)
        self.depth = math.ceil(math.log2(n / least)) if n > least else 0
        self.leaf = -(-n // (1 << self.depth))
        size, self.n, self.k = self.leaf << self.depth, n, k
        if not n:
            return
        # leaves are of one size, so some points stand twice, the second time for nothing
        twice = np.arange(size - n) * n // max(size - n, 1)
        place = np.sort(np.concatenate((np.arange(n), twice)), kind="stable")
        real = np.concatenate(([True], place[1:] != place[:-1]))
        self.pos = order[place]
        self.low: list[list[np.ndarray]] = []  # by level and coordinate
        self.high: list[list[np.ndarray]] = []
        for level in range(self.depth + 1):
            points = x[self.pos].reshape(1 << level, -1, x.shape[1])
            low, high = points.min(axis=1), points.max(axis=1)
            self.low.append(list(np.ascontiguousarray(low.T)))
            self.high.append(list(np.ascontiguousarray(high.T)))
            if level < self.depth:
                widest = (high - low).argmax(axis=1)
                along = np.take_along_axis(points, widest[:, None, None], axis=2)[:, :, 0]
                place = np.argpartition(along, along.shape[1] // 2, axis=1)
                self.pos = np.take_along_axis(self.pos.reshape(1 << level, -1), place, axis=1).ravel()
                real = np.take_along_axis(real.reshape(1 << level, -1), place, axis=1).ravel()
        self.points = [np.where(real, c, np.inf) for c in x[self.pos].T]

    def _gaps(self, x: list[np.ndarray], level: int, node: np.ndarray) -> np.ndarray:
        total = np.zeros(node.shape)
        for own, low, high in zip(x, self.low[level], self.high[level], strict=True):
            d = low.take(node)
            d -= own
            e = high.take(node)
            np.subtract(own, e, out=e)
            np.maximum(d, e, out=d)
            np.maximum(d, 0.0, out=d)
            d *= d
            total += d
        return total

    def _squares(self, x: list[np.ndarray], slot: np.ndarray) -> np.ndarray:
        total = np.zeros(slot.shape)
        for own, points in zip(x, self.points, strict=True):
            d = points.take(slot)
            d -= own
            d *= d
            total += d
        return total

    def search(self, x: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, rounded distance) of the k best of each row of ``x``; ``factor`` scales the squares."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not self.n or not len(x):
            return none
        found = [none]
        for s in range(0, len(x), QUERIES_AT_ONCE):
            part = x[s : s + QUERIES_AT_ONCE]
            limit = self._bound(part, factor)
            for at, (rows, pos, square) in self._within(part, limit):
                near = _up_to_kth(rows, square, self.k, factor)
                rows, pos, dist = _nearest_of(rows[near], pos[near], square[near], self.k, factor)
                found.append((rows + s + at, pos, dist))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _bound(self, x: np.ndarray, factor: float) -> np.ndarray:
        """The k-th square in a few leaves bounds the k-th of all: those down the nearest boxes, and those down
        the boxes whose farthest corner is nearest, which are the small ones where boxes meet."""
        last = max(self.depth - 1, 0)
        width = self.leaf << (self.depth - last)
        own = [c[:, None] for c in x.T]
        limit = np.full(len(x), np.inf)
        if width < self.k:
            return limit
        for share in (1e-6, 1.0):
            node, level = np.zeros(len(x), np.int64), 0
            while level < last:
                step = min(3, last - level)
                level += step
                kids = (node[:, None] << step) + np.arange(1 << step)
                node = kids[np.arange(len(x)), (self._gaps(own, level, kids) + share * self._far(own, level, kids)).argmin(axis=1)]
            square = self._squares(own, node[:, None] * width + np.arange(width))
            limit = np.minimum(limit, np.partition(square, self.k - 1, axis=1)[:, self.k - 1])
        return _limit(limit, factor)

    def _far(self, x: list[np.ndarray], level: int, node: np.ndarray) -> np.ndarray:
        total = np.zeros(node.shape)
        for own, low, high in zip(x, self.low[level], self.high[level], strict=True):
            total += np.maximum(own - low.take(node), high.take(node) - own) ** 2
        return total

    def _within(self, x: np.ndarray, limit: np.ndarray, at: int = 0):
        """(first row, pairs) with all points up to each row's limit, in pieces of bounded size."""
        rows, node, level = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        columns = list(np.ascontiguousarray(x.T))
        while level < self.depth:
            step = min(2, self.depth - level)
            level += step
            if self._halved(x, len(rows) << step):
                yield from self._halves(x, limit, at)
                return
            rows = np.repeat(rows, 1 << step)
            node = ((node[:, None] << step) + np.arange(1 << step)).ravel()
            near = np.flatnonzero(self._gaps([c.take(rows) for c in columns], level, node) <= limit.take(rows))
            rows, node = rows.take(near), node.take(near)
        if self._halved(x, len(rows) * self.leaf):
            yield from self._halves(x, limit, at)
            return
        slot = node[:, None] * self.leaf + np.arange(self.leaf)
        square = self._squares([c.take(rows)[:, None] for c in columns], slot)
        one, two = np.nonzero((square <= limit.take(rows)[:, None]) & np.isfinite(square))
        yield at, (rows[one], self.pos[slot[one, two]], square[one, two])

    @staticmethod
    def _halved(x: np.ndarray, pairs: int) -> bool:
        return pairs > BOX_PAIRS and len(x) > 1

    def _halves(self, x: np.ndarray, limit: np.ndarray, at: int):
        half = len(x) // 2
        yield from self._within(x[:half], limit[:half], at)
        yield from self._within(x[half:], limit[half:], at + half)


def _by_products(x: np.ndarray, v: np.ndarray, k: int, factor: float, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best by matrix products, whose rounding the limit allows for; the pairs left are compared exactly.

    Tile after tile, what may be nearer than the k-th so far is kept; ``far`` are distances beyond which nothing is wanted.
    Products are of single precision; where that leaves too many pairs of a tile, it is done again in double.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(v) or not len(x):
        return none
    if max(np.abs(x).max(), np.abs(v).max()) >= LARGE:
        return _plainly(x, v, k, factor)
    limits = np.full(len(x), np.inf) if far is None else _loose(far) ** 2 / factor * (1 + 1e-12)
    centre = v.mean(axis=0)
    sides = {}

    def side(kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        if kind not in sides:
            a, b = x - centre, v - centre
            mine, own = (a * a).sum(axis=1), (b * b).sum(axis=1)
            slack = 4 * (x.shape[1] + 8) * float(np.finfo(kind).eps) * (mine + own.max())
            # squares less those of the query in one product
            sides[kind] = (np.column_stack((a, np.ones(len(a)))).astype(kind), np.vstack((-2.0 * b.T, own)).astype(kind), mine, slack)
        return sides[kind]

    found = [none]
    for s in range(0, len(x), TILE[0]):
        part = x[s : s + TILE[0]]
        most, best = limits[s : s + TILE[0]], none
        for t in range(0, len(v), TILE[1]):
            for kind in (np.float32, np.float64):
                a, b, mine, slack = side(kind)
                mine, slack = mine[s : s + TILE[0]], slack[s : s + TILE[0]]
                near = a[s : s + TILE[0]] @ b[:, t : t + TILE[1]]
                open_ = np.flatnonzero(np.isinf(most))
                if near.shape[1] > k and (len(open_) or kind is np.float64):
                    open_ = open_ if kind is np.float32 else np.arange(len(part))
                    kth = np.partition(near[open_], k - 1, axis=1)[:, k - 1] + mine[open_]
                    most = most.copy()
                    most[open_] = np.minimum(most[open_], _limit(np.maximum(kth, 0.0) + slack[open_], factor))
                up_to = np.nextafter((most + slack - mine).astype(kind), kind(np.inf))
                rows, pos = np.nonzero(near <= up_to[:, None])
                if len(rows) <= MANY * k * len(part):
                    break
            if not len(rows):
                continue
            square = np.zeros(len(rows))
            for j in range(x.shape[1]):
                d = part[rows, j] - v[pos + t, j]
                square += d * d
            dist = np.round(np.sqrt(square * factor), DIGITS)
            best = _first(*(np.concatenate(c) for c in zip(best, (rows, pos + t, dist), strict=True)), k)
            first = np.searchsorted(best[0], np.arange(len(part) + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            most = most.copy()
            most[full] = np.minimum(most[full], _loose(best[2][first[full] + k - 1]) ** 2 / factor * (1 + 1e-12))
        found.append((best[0] + s, best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _plainly(x: np.ndarray, v: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best from plain differences, for numbers whose products may overflow."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, PAIR_BLOCK // len(v))
    for s in range(0, len(x), step):
        with np.errstate(over="ignore"):
            rows, pos, dist = _best(_squares(x[s : s + step], v, False) * factor, k)
        found.append((rows + s, pos, dist))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class _Reference:
    """Reference rows in id order with what speeds up searches, made when first asked for."""

    def __init__(self, pdf: pd.DataFrame, shape: _Shape):
        pdf = pdf.sort_values("_v", kind="stable")
        self.x, self.ids, self.pay = pdf[shape.xs].to_numpy(dtype=float), pdf["_v"].to_numpy(), pdf[shape.ps].to_numpy(dtype=float)
        self.k = shape.k
        self.made: dict = {}

    def _only(self, key, chosen, coordinates: list[int]):
        """(positions, searcher) for some rows on some coordinates."""
        if key not in self.made:
            at = np.flatnonzero(chosen())
            x = np.ascontiguousarray(self.x[at][:, coordinates])
            self.made[key] = (at, _Boxes(x, self.k) if len(coordinates) <= WIDE else x)
        return self.made[key]

    def _look(self, x: np.ndarray, key, chosen, coordinates: list[int], factor: float, far: np.ndarray | None = None):
        at, searcher = self._only(key, chosen, coordinates)
        x = x[:, coordinates]
        rows, pos, dist = searcher.search(x, factor) if isinstance(searcher, _Boxes) else _by_products(x, searcher, self.k, factor, far)
        return rows, at[pos], dist

    def nearest(self, x: np.ndarray, factor: float = 1.0, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, rounded distance) of the k best; rows with a number that is not finite have and are no neighbours.
        What is beyond ``far`` may be left out."""
        fine = np.flatnonzero(np.isfinite(x).all(axis=1))
        rows, pos, dist = self._look(x[fine], "all", lambda: np.isfinite(self.x).all(axis=1), list(range(x.shape[1])), factor, None if far is None else far[fine])
        return fine[rows], pos, dist

    def nearest_shared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same over the coordinates that two rows share, one search for each pattern of gaps and shared set."""
        width = x.shape[1]
        if "patterns" not in self.made:
            self.made["patterns"] = (None if np.isinf(self.x).any() else np.unique(~np.isnan(self.x), axis=0)), ~np.isnan(self.x)
        patterns, has = self.made["patterns"]
        mine, which = np.unique(~np.isnan(x), axis=0, return_inverse=True)
        if patterns is None or len(patterns) > MAX_PATTERNS or len(mine) > MAX_PATTERNS or np.isinf(x).any():
            return self._all_pairs(x)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for number, pattern in enumerate(mine):
            at = np.flatnonzero(which.ravel() == number)
            for shared in np.unique(patterns & pattern, axis=0):
                if shared.any():
                    key = (pattern.tobytes(), shared.tobytes())
                    chosen = lambda p=pattern, s=shared: ((has & p) == s).all(axis=1)
                    rows, pos, dist = self._look(x[at], key, chosen, np.flatnonzero(shared).tolist(), width / shared.sum())
                    found.append((at[rows], pos, dist))
        return _first(*(np.concatenate(c) for c in zip(*found, strict=True)), self.k)

    def _all_pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, PAIR_BLOCK // max(len(self.ids), 1))
        for s in range(0, len(x), step):
            rows, pos, dist = _best(_squares(x[s : s + step], self.x, True), self.k)
            found.append((rows + s, pos, dist))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _search(pdf: pd.DataFrame, ref: _Reference, shape: _Shape, factor: float | None = None, along: tuple[str, ...] = ()) -> pd.DataFrame:
    """The k best of ``ref`` for every row of ``pdf``; ``factor``: both are in one view of rows with gaps."""
    x = pdf[shape.xs].to_numpy(dtype=float)
    rows, pos, dist = ref.nearest_shared(x) if shape.nan_aware and factor is None else ref.nearest(x, factor or 1.0, pdf["_limit"].to_numpy(dtype=float) if "_limit" in along else None)
    base = pdf.iloc[rows]
    out = {"_q": base["_q"].to_numpy()}
    out |= {name: base[name].to_numpy() for name in (*shape.carry, *along)}
    out |= {"rank": (np.arange(len(rows)) - np.searchsorted(rows, rows) + 1).astype("int32"), "_v": ref.ids[pos], "dist": dist}
    out |= {p: ref.pay[pos, i] for i, p in enumerate(shape.ps)}
    return pd.DataFrame(out)


def _broadcast_form(q: DataFrame, near: pd.DataFrame, shape: _Shape) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast(_Reference(near, shape))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(shared.value.ids):
                yield _search(pdf, shared.value, shape)

    return _spread(q).mapInPandas(scan, shape.out(q)).select(*shape.names)


def _spread(q: DataFrame) -> DataFrame:
    """Spread the queries evenly.

    A query's search costs far more than moving its vector once, and a source
    may have few or uneven splits.
    """
    spark = q.sparkSession
    return q.repartition(max(spark.sparkContext.defaultParallelism, shuffle_width(spark)))


def _drop_surplus_copies(v: DataFrame, shape: _Shape) -> DataFrame:
    """Keep the k lowest ids of equal vectors of a view (the window keeps k per task before it shuffles)."""
    w = W.partitionBy("_g", *shape.xs).orderBy("_v")
    return v.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= shape.k).drop("_n")


def _chunked_form(q: DataFrame, v: DataFrame, shape: _Shape, pivots: int | None, n: int) -> DataFrame:
    views = None
    if shape.width > WIDE:
        # cells of many coordinates rule out little, so they are as large as a task may hold: each query is sent to fewer
        shape = replace(shape, chunk=max(1_000, min(BROADCAST_CELLS // shape.width, n // WIDE_PARTS)))
    if shape.nan_aware:
        q, v = cut(q), cut(v)
        views = _gap_views(q, v, shape)
        if views is None:
            home, visits = _assign_gap_cells(q, v, shape, pivots or min(MAX_PIVOTS, max(16, math.isqrt(n))))
            return _top(_meet(home, visits, shape, shape.out(q)), shape)
    out = shape.out(q)
    q, v, factors = _split_views(q, v, shape, views)
    v = cut(_drop_surplus_copies(v, shape))
    home, first, index = _assign_cells(q, v, shape, pivots, len(factors))
    one = cut(_meet(home, first, shape, f"_g int, {out}", factors))
    best = one.groupBy("_q", "_g").agg(F.when(F.count("dist") >= shape.k, F.max("dist")).alias("_limit"))
    more = _meet(home, _further(first, best, shape, index, factors), shape, f"_g int, {out}", factors)
    return _top(one.unionByName(more), shape)


def _is_there(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x)


def _gap_views(q: DataFrame, v: DataFrame, shape: _Shape) -> tuple[list[int], list[tuple[int, int]]] | None:
    """Patterns of the reference rows and (pattern of a query, shared coordinates) of every view, as bits.

    None where there are too many patterns, or a number is infinite.
    """
    if shape.width > 62:
        return None
    sides = []
    for df in (q, v):
        endless = reduce(lambda a, b: a | b, [F.coalesce(F.abs(x) == float("inf"), F.lit(False)) for x in shape.xs])
        rows = df.groupBy(_pattern(shape).alias("m")).agg(F.max(endless).alias("endless")).limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS or any(r["endless"] for r in rows):
            return None
        sides.append(sorted(r["m"] for r in rows))
    views = sorted({(p, p & d) for p in sides[0] for d in sides[1] if p & d})
    return (sides[1], views) if len(views) <= MAX_VIEWS else None


def _pattern(shape: _Shape) -> Column:
    return reduce(lambda a, b: a + b, [F.when(_is_there(x), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(shape.xs)])


def _split_views(q: DataFrame, v: DataFrame, shape: _Shape, found) -> tuple[DataFrame, DataFrame, list[float]]:
    """Both sides with the number ``_g`` of each view that a row is in, and the factor of each view's squares.

    Without gaps there is one view, without the rows that have no finite distance. With gaps, coordinates
    that are not shared become 0 on both sides.
    """
    if found is None:
        for x in shape.xs:
            q, v = (df.filter(_is_there(x) & (F.abs(x) < float("inf"))) for df in (q, v))
        return q.withColumn("_g", F.lit(0)), v.withColumn("_g", F.lit(0)), [1.0]
    patterns, views = found

    def split(df: DataFrame, member: dict[int, list[int]]) -> DataFrame:
        groups = F.array().cast("array<int>")
        for pattern, numbers in member.items():
            groups = F.when(F.col("_m") == pattern, F.array(*map(F.lit, numbers)).cast("array<int>")).otherwise(groups)
        df = df.withColumn("_m", _pattern(shape)).withColumn("_g", F.explode(groups)).drop("_m")
        if not views:
            return df
        shared = F.element_at(F.array(*[F.lit(s).cast("long") for _, s in views]), F.col("_g") + 1)
        return df.withColumns({x: F.when(shared.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col(x)).otherwise(0.0) for i, x in enumerate(shape.xs)})

    asks = {p: [g for g, (a, _) in enumerate(views) if a == p] for p, _ in views}
    gives = {d: [g for g, (a, s) in enumerate(views) if a & d == s] for d in patterns}
    gives = {d: numbers for d, numbers in gives.items() if numbers}
    return split(q, asks), split(v, gives), [shape.width / s.bit_count() for _, s in views]


def _meet(home: DataFrame, visits: DataFrame, shape: _Shape, out: str, factors: list[float] | None = None) -> DataFrame:
    """The k best of each visit. With ``factors`` a visit of the ``_own`` cell takes the query's own chunk of it;
    with ``_limit`` all other chunks, and what is beyond the limit stays out."""
    again = "_limit" in visits.columns
    chunk_rows = shape.chunk or CHUNK_ROWS
    sizes = home.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nv"))
    loads = visits.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nq"))
    plan = sizes.join(loads, "_cell").select(
        "_cell",
        F.ceil(F.col("_nv") / chunk_rows).cast("int").alias("_cv"),
        F.ceil(F.col("_nq") / chunk_rows).cast("int").alias("_cq"),
    )
    plan = F.broadcast(plan)  # at most one row per pivot
    own = F.pmod(F.xxhash64("_q"), F.col("_cv").cast("long"))
    chunks = F.sequence(F.lit(0).cast("long"), (F.col("_cv") - 1).cast("long"))
    if factors is not None:
        chunks = F.filter(chunks, lambda c: (F.col("_cell") != F.col("_own")) | (c != own)) if again else F.array(own)
    # block nested loop inside a cell: each side is chunked and meets every chunk of the other
    extra = [c for c in ("_g", "_limit") if c in visits.columns]
    left = (
        visits.join(plan, "_cell")
        .withColumn("_qc", F.pmod(F.xxhash64("_q", F.lit(1)), F.col("_cq")))
        .withColumn("_vc", F.explode(chunks))
        .select("_cell", "_qc", "_vc", "_q", *shape.xs, *shape.carry, *extra)
    )
    right = (
        home.join(plan, "_cell")
        .withColumn("_vc", F.pmod(F.xxhash64("_v"), F.col("_cv")))
        .withColumn("_qc", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_cq") - 1).cast("long"))))
        .select("_cell", "_qc", "_vc", "_v", *shape.xs, *shape.ps)
    )
    names = ([] if factors is None else ["_g"]) + shape.names

    def block(lq: pd.DataFrame, rv: pd.DataFrame) -> pd.DataFrame:
        if len(lq) == 0 or len(rv) == 0:
            return pd.DataFrame({n: [] for n in names})
        factor = None if factors is None else factors[int(lq["_g"].iloc[0])]
        found = _search(lq, _Reference(rv, shape), shape, factor, tuple(extra))
        return (found[found["dist"] <= found["_limit"]] if again else found)[names]

    keys = ["_cell", "_qc", "_vc"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, out)


def _top(partial: DataFrame, shape: _Shape) -> DataFrame:
    w = W.partitionBy("_q").orderBy("dist", "_v")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= shape.k)


def _loose(limit: np.ndarray) -> np.ndarray:
    """A bound that rounding, of sums or of the distances themselves, never falls short of."""
    return limit * (1 + 1e-12) + 2 * 10.0**-DIGITS


def least_mean_gap(gap: np.ndarray, always: np.ndarray, sometimes: np.ndarray) -> np.ndarray:
    """(row, cell): the least mean of squared gaps over the coordinates shared for sure and any of those shared perhaps;
    infinite where no coordinate can be shared. All are (row, cell, coordinate)."""
    sure, n = np.where(always, gap, 0.0).sum(axis=2), always.sum(axis=2)
    rest = np.sort(np.where(sometimes, gap, np.inf), axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        best = np.where(n > 0, sure / n, np.inf)
        for m in range(rest.shape[2]):  # the smallest ones first lower the mean most
            sure, n = sure + rest[:, :, m], n + 1
            best = np.fmin(best, sure / n)
    return best


def _assign_gap_cells(q: DataFrame, v: DataFrame, shape: _Shape, n_pivots: int):
    """As :func:`_assign_cells` for rows with gaps. The index has ``n_pivots`` cells and k rows of each at most."""
    spark, k, xs = v.sparkSession, shape.k, shape.xs
    width = len(xs)
    picked = v.orderBy(draw_fast("_v", "pivot", 0), "_v").limit(n_pivots).select(*xs).distinct().toPandas()
    shared = spark.sparkContext.broadcast(picked.to_numpy(dtype=float))
    step = max(1, PAIR_BLOCK // max(len(picked) * width, 1))

    @F.pandas_udf("struct<_cell:int,_r:double>")
    def nearest(*cols: pd.Series) -> pd.DataFrame:
        x, pivots = np.column_stack([c.to_numpy(dtype=float) for c in cols]), shared.value
        parts = []
        for s in range(0, len(x), step):
            rows = x[s : s + step]
            d = _squares(rows, pivots, True)
            alike = (np.isnan(rows)[:, None, :] == np.isnan(pivots)[None, :, :]).all(axis=2)
            d = np.where(alike.any(axis=1)[:, None] & ~alike, np.inf, d)  # a pivot of the own pattern, if there is one
            cell = d.argmin(axis=1)
            parts.append(pd.DataFrame({"_cell": cell.astype("int32"), "_r": d[np.arange(len(d)), cell]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"_cell": [], "_r": []})

    home = cut(v.withColumn("_near", nearest(*xs)).select(*v.columns, "_near._cell", "_near._r"))
    facts = [f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    cells = home.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *facts).toPandas().sort_values("_cell")
    w = W.partitionBy("_cell").orderBy("_r", "_v")
    kept = home.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select(*xs).toPandas()
    ranges = [cells[[f"{n}{x}" for x in xs]].to_numpy(dtype=float) for n in ("lo", "hi", "n")]
    index = (cells["_cell"].to_numpy(), *ranges, cells["n"].to_numpy(dtype=float), kept.to_numpy(dtype=float))
    bounds = spark.sparkContext.broadcast(index)
    at_once = max(1, PAIR_BLOCK // max((len(cells) + len(kept)) * width, 1))

    @F.pandas_udf("array<int>")
    def visit(*cols: pd.Series) -> pd.Series:
        names, low, high, count, size, near = bounds.value
        x, out = np.column_stack([c.to_numpy(dtype=float) for c in cols]), []
        for s in range(0, len(x), at_once):
            rows = x[s : s + at_once]
            d = _squares(rows, near, True)
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(rows), np.inf)
            has = ~np.isnan(rows)[:, None, :]
            beyond = np.fmax(0.0, np.fmax(low[None] - rows[:, None, :], rows[:, None, :] - high[None])) ** 2
            always, sometimes = has & (count == size[:, None])[None], has & ((count > 0) & (count < size[:, None]))[None]
            least = least_mean_gap(beyond, always, sometimes) * width
            need = np.isfinite(least) & (np.sqrt(least) <= _loose(np.sqrt(limit))[:, None])
            out += [names[row].astype("int32") for row in need]
        return pd.Series(out)

    visits = cut(q.withColumn("_cells", visit(*xs)))
    return home, visits.withColumn("_cell", F.explode("_cells")).drop("_cells")


@dataclass(frozen=True)
class _Cells:
    """What is known of the cells of each view: numbers, pivots, radius and ranges, by position."""

    number: list[np.ndarray]
    pivots: list[np.ndarray]
    radius: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]


def _pivots(v: DataFrame, shape: _Shape, pivots: int | None, views: int) -> list[np.ndarray]:
    """Distinct reference rows of each view, drawn by a hash; as many as its cells should be."""
    counts = {r["_g"]: r["count"] for r in v.groupBy("_g").count().collect()}  # one row per view

    def wanted(n: int) -> int:
        if shape.width > WIDE:
            return min(MAX_PIVOTS, pivots or -(-n // shape.chunk))
        return min(MAX_PIVOTS, max(-(-(pivots or 16) // views), -(-n // CELL_ROWS)))

    share = [(wanted(n) + 4 * math.sqrt(wanted(n)) + 8) / n if (n := counts.get(g, 0)) else 0.0 for g in range(views)]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("pivot"), "_v", *shape.xs), 32).cast("double") / 4294967296.0
    drawn = v.withColumn("_draw", draw).filter(F.col("_draw") < F.element_at(F.array(*map(F.lit, share)), F.col("_g") + 1))
    picked = drawn.select("_g", "_draw", "_v", *shape.xs).toPandas().sort_values(["_draw", "_v"])  # a few more than the pivots
    out = []
    for g in range(views):
        mine = picked[picked["_g"] == g].head(wanted(counts.get(g, 0)))
        if not len(mine) and g in counts:
            mine = v.filter(F.col("_g") == g).limit(1).toPandas()
        out.append(mine[shape.xs].drop_duplicates().to_numpy(dtype=float))
    return out


def _assign_cells(q: DataFrame, v: DataFrame, shape: _Shape, pivots: int | None, views: int) -> tuple[DataFrame, DataFrame, _Cells]:
    """Home cell of every reference row, the cell of each query's nearest pivot as a first visit, and the index of the cells."""
    spark, xs = v.sparkSession, shape.xs
    chosen = _pivots(v, shape, pivots, views)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in chosen])))
    shared = spark.sparkContext.broadcast(chosen)

    @F.pandas_udf("struct<_cell:int,_r:double>")
    def nearest(g: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        x, group = np.column_stack([c.to_numpy(dtype=float) for c in cols]), g.to_numpy()
        cell, r = np.full(len(x), -1, np.int32), np.full(len(x), np.nan)
        for view in np.unique(group):
            at, points = np.flatnonzero(group == view), shared.value[view]
            step = max(1, PAIR_BLOCK // max(len(points), 1))
            for s in range(0, len(at) if len(points) else 0, step):
                some = at[s : s + step]
                d = _squares(x[some], points, False)
                best = d.argmin(axis=1)
                cell[some], r[some] = best + starts[view], np.sqrt(d[np.arange(len(d)), best])
        return pd.DataFrame({"_cell": cell, "_r": r})

    near = nearest("_g", *xs)
    home = cut(v.withColumn("_near", near).select(*v.columns, "_near._cell", "_near._r"))
    first = cut(q.withColumn("_near", near).select(*q.columns, F.col("_near._cell").alias("_cell"), F.col("_near._cell").alias("_own")))
    ranges = [f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max))]
    facts = home.groupBy("_cell").agg(F.max("_r").alias("_r"), *ranges).toPandas().set_index("_cell")  # one row per pivot
    parts = [facts[(facts.index >= a) & (facts.index < b)].sort_index() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return home, first, _Cells(
        [p.index.to_numpy(dtype="int32") for p in parts],
        [points[p.index.to_numpy() - a] for p, points, a in zip(parts, chosen, starts[:-1], strict=True)],
        [p["_r"].to_numpy(dtype=float) for p in parts],
        *[[p[[f"{n}{x}" for x in xs]].to_numpy(dtype=float) for p in parts] for n in ("lo", "hi")],
    )


def _further(first: DataFrame, best: DataFrame, shape: _Shape, index: _Cells, factors: list[float]) -> DataFrame:
    """All cells that may hold rows within each query's limit, by the triangle inequality and their ranges."""
    bounds = first.sparkSession.sparkContext.broadcast((index, factors))
    per_row = max(max((len(n) for n in index.number), default=0), 1)

    @F.pandas_udf("array<int>")
    def visit(g: pd.Series, limit: pd.Series, *cols: pd.Series) -> pd.Series:
        cells, scale = bounds.value
        x, group = np.column_stack([c.to_numpy(dtype=float) for c in cols]), g.to_numpy()
        most = np.where(np.isnan(limit.to_numpy(dtype=float)), np.inf, limit.to_numpy(dtype=float))
        out: list = [None] * len(x)
        step = max(1, PAIR_BLOCK // per_row)
        for view in np.unique(group):
            at, root = np.flatnonzero(group == view), math.sqrt(scale[view])
            radius = cells.radius[view]
            for s in range(0, len(at), step):
                some = at[s : s + step]
                rows, far = x[some], _loose(most[some])[:, None]
                d = np.sqrt(_squares(rows, cells.pivots[view], False))
                # differences of two distances: what rounding may take is in proportion to them
                need = (d * (1 - 1e-12) - radius * (1 + 1e-12)) * root <= far
                if shape.width <= WIDE:
                    gap = np.zeros(d.shape)
                    for j in range(rows.shape[1]):
                        one = np.maximum(np.maximum(cells.low[view][:, j] - rows[:, None, j], rows[:, None, j] - cells.high[view][:, j]), 0.0)
                        gap += one * one
                    need &= np.sqrt(gap) * root <= far
                for row, mask in zip(some.tolist(), need, strict=True):
                    out[row] = cells.number[view][mask]
        return pd.Series(out, dtype=object)

    same = F.col("_q").eqNullSafe(F.col("_bq")) & (F.col("_g") == F.col("_bg"))
    bounded = first.drop("_cell").join(best.select(F.col("_q").alias("_bq"), F.col("_g").alias("_bg"), "_limit"), same, "left").drop("_bq", "_bg")
    visits = bounded.withColumn("_cells", visit("_g", "_limit", *shape.xs)).withColumn("_limit", F.coalesce("_limit", F.lit(float("inf"))))
    return cut(visits).withColumn("_cell", F.explode("_cells")).drop("_cells")
