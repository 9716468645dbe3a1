"""Sums of products by pattern of gaps, and regressions replayed on them.

Rows that lack the same columns are filled by the same linear map of what they have. So the sums of products of their
filled values follow from the sums over the rows as they came: a regression that fills column j replaces row and
column j of each pattern's matrix by a combination of the others. One scan adds the matrices up; any number of
regressions in turn then works on matrices, one for each pattern, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.scalar import c
from gapweave.session import cut

#: Bytes of matrices that a task holds before it hands them on, and that the driver works on itself; more
#: patterns stay a table, and each step is a job over that table.
HELD = 64 << 20


@dataclass
class LinearStep:
    target: int
    coef: np.ndarray  # one weight per feature, 0 at the target
    intercept: float


def known(x: str | Column) -> Column:
    """The value as a double; NaN is a gap as null is."""
    return F.nanvl(c(x).cast("double"), F.lit(None).cast("double"))


class Patterns:
    """Matrices of sums of products, one for each pattern, and what the regressions so far make of them.

    ``gaps`` marks the columns that a pattern lacks; ``gram`` holds the sums of products of (1, values), where values
    are measured from given centres and gaps are 0; ``most`` the largest absolute value of each column.
    """

    def __init__(self, gaps: np.ndarray, gram: np.ndarray, most: np.ndarray):
        self.gaps, self.first, self.most = gaps, gram, most
        self.gram = gram.copy()
        size = gram.shape[-1]
        self.map = np.tile(np.eye(size), (len(gaps), 1, 1))  # what a filled row is made of

    def apply(self, step: LinearStep) -> None:
        hit, at = np.flatnonzero(self.gaps[:, step.target]), step.target + 1
        if not len(hit):
            return
        weights = np.concatenate(([step.intercept], step.coef))
        row = self.gram[hit] @ weights
        row[:, at] = row @ weights
        self.gram[hit, at, :] = row
        self.gram[hit, :, at] = row
        self.map[hit, at, :] = np.einsum("k,pkm->pm", weights, self.map[hit])

    def sums(self, target: int) -> np.ndarray:
        """Sums of products over the rows where the column is known."""
        return self.gram[~self.gaps[:, target]].sum(axis=0)

    def move(self, before: np.ndarray) -> tuple[float, float]:
        """Bounds of the largest change of a filled value since the maps were ``before``: the root mean square of a pattern's
        rows is below it, the sum over the largest absolute values above."""
        change = (self.map - before)[:, 1:, :]
        square = np.einsum("pjk,pkm,pjm->pj", change, self.first, change) / np.maximum(self.first[:, 0, 0], 1)[:, None]
        most = np.concatenate((np.ones((len(self.most), 1)), self.most), axis=1)
        high = np.einsum("pjk,pk->pj", np.abs(change), most)
        return float(np.sqrt(np.clip(square, 0, None)).max(initial=0.0)), float(high.max(initial=0.0))


def sums_by_pattern(df: DataFrame, features: list[str], centres: dict[str, float]) -> DataFrame:
    """(pattern, gram, most) of ``df``: one scan and a shuffle of one matrix per task and pattern."""
    d = len(features)
    upper = np.triu_indices(d + 1)
    centre = np.array([centres[x] for x in features])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[np.ndarray]] = {}

        def close() -> pa.RecordBatch:
            grams, most = [x[0][upper].tobytes() for x in held.values()], [x[1].tobytes() for x in held.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(grams, pa.binary()), pa.array(most, pa.binary())], ["pattern", "gram", "most"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(d)], axis=1) - centre
                gaps = np.isnan(x)
                z = np.hstack([np.ones((len(x), 1)), np.where(gaps, 0.0, x)])
                kinds, of = np.unique(np.packbits(gaps, axis=1), axis=0, return_inverse=True)
                order = np.argsort(of.ravel(), kind="stable")
                edges = np.searchsorted(of.ravel()[order], np.arange(len(kinds) + 1))
                for kind, i, j in zip(kinds, edges[:-1], edges[1:], strict=True):
                    rows = z[order[i:j]]
                    gram, most = rows.T @ rows, np.abs(rows[:, 1:]).max(axis=0)
                    mine = held.get(bytes(kind))
                    held[bytes(kind)] = [gram, most] if mine is None else [mine[0] + gram, np.maximum(mine[1], most)]
                if len(held) * (d + 1) ** 2 * 8 > HELD:
                    yield close()
        if held:
            yield close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gram, most = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([gram.tobytes()], pa.binary()), pa.array([most.tobytes()], pa.binary())], ["pattern", "gram", "most"])

        for batch in batches:
            for pattern, g, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                g, m = np.frombuffer(g), np.frombuffer(m)
                if pattern == now:
                    gram, most = gram + g, np.maximum(most, m)
                    continue
                if now is not None:
                    yield row()
                now, gram, most = pattern, g, m
        if now is not None:
            yield row()

    kinds = "pattern binary, gram binary, most binary"
    partial = df.select(*[known(x) for x in features]).mapInArrow(add, kinds)
    return partial.repartition("pattern").sortWithinPartitions("pattern", "gram").mapInArrow(merge, kinds)


def unpack(batch: pa.RecordBatch | pa.Table, d: int) -> Patterns:
    """The matrices of some rows of :func:`sums_by_pattern`."""
    pattern, gram, most = (b"".join(batch.column(k).to_pylist()) for k in ("pattern", "gram", "most"))
    n, upper = batch.num_rows, np.triu_indices(d + 1)
    gaps = np.unpackbits(np.frombuffer(pattern, np.uint8).reshape(n, -1), axis=1)[:, :d].astype(bool)
    full = np.zeros((n, d + 1, d + 1))
    full[:, upper[0], upper[1]] = np.frombuffer(gram).reshape(n, -1)
    full[:, upper[1], upper[0]] = full[:, upper[0], upper[1]]
    return Patterns(gaps, full, np.frombuffer(most).reshape(n, d))


class PatternTable:
    """The same sums while steps are fitted: on the driver if the matrices fit in ``held`` bytes, else as a table."""

    def __init__(self, df: DataFrame, features: list[str], centres: dict[str, float], held: int = HELD):
        self.d, self.steps = len(features), []
        table = cut(sums_by_pattern(df, features, centres))
        self.table, self.local = table, None
        if table.count() * (self.d + 1) ** 2 * 16 <= held:
            self.local = unpack(table.orderBy("pattern").toArrow(), self.d)

    def apply(self, step: LinearStep) -> None:
        self.steps.append(step)
        if self.local:
            self.local.apply(step)

    def sums(self, target: int) -> np.ndarray:
        if self.local:
            return self.local.sums(target)
        d, steps = self.d, list(self.steps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d + 1, d + 1))
            for batch in batches:
                total += _replay(batch, d, steps).sums(target)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

        rows = self.table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((d + 1) ** 2)
        for r in rows:  # (d + 1) squared numbers
            total[r["i"]] = r["v"]
        return total.reshape(d + 1, d + 1)

    def move(self, since: int) -> tuple[float, float]:
        """Bounds of the largest change by the steps from number ``since`` on."""
        d, old, new = self.d, self.steps[:since], self.steps[since:]
        if self.local:
            before = Patterns(self.local.gaps, self.local.first, self.local.most)
            for step in old:
                before.apply(step)
            return self.local.move(before.map)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = 0.0, 0.0
            for batch in batches:
                state = _replay(batch, d, old)
                before = state.map.copy()
                for step in new:
                    state.apply(step)
                a, b = state.move(before)
                low, high = max(low, a), max(high, b)
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high])], ["low", "high"])

        row = self.table.mapInArrow(run, "low double, high double").agg(F.max("low"), F.max("high")).first()
        return row[0] or 0.0, row[1] or 0.0


def _replay(batch: pa.RecordBatch, d: int, steps: list[LinearStep]) -> Patterns:
    out = unpack(batch, d)
    for step in steps:
        out.apply(step)
    return out
