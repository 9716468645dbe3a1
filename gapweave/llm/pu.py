"""Non-negative positive-unlabelled learning over binary features, in numpy.

A sample of texts with the wanted label (positives) and a sample of texts whose label is not used
(unlabelled) train a linear classifier. With class prior p the risk is

    p * mean_P loss(+1) + max(0, mean_U loss(-1) - p * mean_P loss(-1))

When the bracket turns negative, the unlabelled part is overfitted and a step goes the other way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import keep_types, slices, unit_draw

#: At most about so many rows of each kind fit the classifier.
FIT_ROWS = 8_000
#: Features kept, and the least standard score of the difference of their rates in both samples.
FEATURES, LEAST_Z = 4_096, 3.0


@dataclass
class Model:
    """Weights by feature number; ``prior`` is the class prior used."""

    prior: float
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, features) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in features)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _rates(ids: np.ndarray, universe: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(np.searchsorted(universe, ids), minlength=len(universe)) / max(n, 1)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 900, rate: float = 0.1, decay: float = 1e-6, beta: float = 0.0) -> Model:
    """Minimise the non-negative risk by Adam steps over both samples.

    Without positives or without unlabelled rows the model is the prior alone.
    """
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    bias = float(np.log(prior / (1 - prior)))
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return Model(prior, bias)
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (positive, unlabelled)]
    universe = np.unique(np.concatenate(flat))
    p, u = _rates(flat[0], universe, n_p), _rates(flat[1], universe, n_u)
    both = (p * n_p + u * n_u) / (n_p + n_u)
    z = np.abs(p - u) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_p + 1 / n_u))
    best = np.flatnonzero(z >= LEAST_Z)
    best = np.sort(best[np.argsort(-z[best], kind="stable")][:FEATURES])
    kept = universe[best]

    rows, cols = [], []
    for at, ids in enumerate([*positive, *unlabelled]):
        where = np.searchsorted(kept, ids)
        where = where[(where < len(kept)) & (kept[np.minimum(where, max(len(kept) - 1, 0))] == ids)] if len(kept) else where[:0]
        rows.append(np.full(len(where), at))
        cols.append(where)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    is_p = np.arange(n_p + n_u) < n_p
    w = np.zeros(len(kept) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        score = np.bincount(rows, w[cols], n_p + n_u) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        loss_minus = np.logaddexp(0, score)
        rest = loss_minus[~is_p].mean() - prior * loss_minus[is_p].mean()
        # slopes of the two parts of the risk by each row's score
        rest_slope = np.where(is_p, -prior * s / n_p, s / n_u)
        slope = np.where(is_p, prior * (s - 1) / n_p, 0.0) + rest_slope if rest >= -beta else -rest_slope
        g = np.append(np.bincount(cols, slope[rows], len(kept)), slope.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(prior, float(w[-1]), {int(f): float(x) for f, x in zip(kept, w[:-1], strict=True) if x})


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[str], Column], features: Callable[[str], set[int]], id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Draw both samples by keyed draws and fit.

    ``learn(id_col)`` marks the rows that may be learnt from. The prior is the share of the label
    among all such labelled rows. Labels of a null id and null labels are left out; of several
    labels of one id the smallest counts. The positives' ids are broadcast: about ``rows`` at most.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn(id_col))
    known = known.groupBy(id_col).agg((F.min(label) == 1).alias("y"))
    n, n_pos = known.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    n_docs = docs.count()
    chosen = known.filter("y").filter(unit_draw(F.col(id_col), seed=11) < rows / max(n_pos, 1))
    chosen = chosen.select(F.col(id_col).alias("id"), F.lit(True).alias("p"))
    source = docs.filter(learn(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("u", unit_draw(F.col("id"), F.col("text"), seed=12) < rows / max(n_docs, 1))
    source = source.join(F.broadcast(chosen), "id", "left").select("p", "u", "text").filter("p or u")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.array(sorted(features(t or "")), "<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["p", "u", "ids"])

    sample = source.mapInArrow(extract, "p boolean, u boolean, ids binary").toArrow()
    ids = [np.frombuffer(x, "<u4") for x in sample["ids"].to_pylist()]
    p, u = sample["p"].to_pylist(), sample["u"].to_pylist()
    return fit([x for x, on in zip(ids, p, strict=True) if on], [x for x, on in zip(ids, u, strict=True) if on], n_pos / n if n else 0.5)


def score(docs: DataFrame, model: Model, scorer: Callable[[Model], Callable[[str], float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row by its whole text; a null text is scored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, keep_types(source, "id") + ", score double").withColumnRenamed("id", id_col)


def flag(docs: DataFrame, model: Model, scorer: Callable[[Model], Callable[[str], float]], out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(t or "") for t in texts], pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, keep_types(docs, *docs.columns) + f", `{out}` double")
