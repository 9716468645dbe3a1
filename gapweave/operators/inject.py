"""Null injection by named mechanism.

A mechanism is reduced to one boolean expression per feature ("this cell is
hidden"). Fitting it costs a few one-row aggregates; applying it is a single
projection, so it adds no shuffle and also runs on a streaming table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.draw import draw, gauss, pick
from gapweave.functions.scalar import sigmoid
from gapweave.operators.ordered import kth_values
from gapweave.session import cut as written

NEWTON_STEPS = 60


@dataclass
class Injected:
    """A table before and after injection; all views share one lineage."""

    source: DataFrame
    features: list[str]
    hidden: dict[str, Column]
    id_col: str

    @property
    def initial(self) -> DataFrame:
        return self.source

    @property
    def incomplete(self) -> DataFrame:
        return self.apply(self.source)

    @property
    def mask(self) -> DataFrame:
        flags = [self.flag(x).alias(f"m_{x}") for x in self.features]
        return self.source.select(self.id_col, *flags)

    @property
    def cells(self) -> DataFrame:
        """(id, feature, truth, is_missing)."""
        parts = [
            F.struct(F.lit(x).alias("feature"), F.col(x).alias("truth"), self.flag(x).alias("is_missing"))
            for x in self.features
        ]
        return self.source.select(self.id_col, F.inline(F.array(*parts)))

    def flag(self, feature: str) -> Column:
        """Never null: a cell whose rule needs a value that is missing is not hidden."""
        return F.coalesce(self.hidden[feature], F.lit(False)) if feature in self.hidden else F.lit(False)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({x: F.when(~self.flag(x), F.col(x)) for x in self.hidden})

    def with_flags(self) -> DataFrame:
        """Source values, ``m_<f>`` flags and ``x_<f>`` incomplete values side by side."""
        flagged = self.source.withColumns({f"m_{x}": self.flag(x) for x in self.features})
        return flagged.withColumns({f"x_{x}": F.when(~F.col(f"m_{x}"), F.col(x)) for x in self.features})


def mean_filled(df: DataFrame, inputs: list[str]) -> dict[str, Column]:
    """Inputs whose gaps count as the column's mean (0 without any value); one aggregate."""
    row = df.agg(*[F.avg(x).alias(x) for x in inputs]).first()
    return {x: F.coalesce(F.col(x), F.lit(row[x] or 0.0)) for x in inputs}


def _weighted(weights: dict[str, float], inputs: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for x, w in weights.items():
        total = total + inputs[x] * F.lit(float(w))
    return total


def unit_variance_weights(
    df: DataFrame, inputs: list[str], targets: list[str], seed: int, filled: dict[str, Column] | None = None
) -> dict[str, dict[str, float]]:
    """Normal weights, scaled so that each weighted sum has sample SD 1 (one aggregate)."""
    filled = filled or mean_filled(df, inputs)
    raw = {t: {i: gauss(f"w:{i}:{t}", seed) for i in inputs} for t in targets}
    sd = df.agg(*[F.stddev_samp(_weighted(raw[t], filled)).alias(t) for t in targets]).first()
    return {t: {i: w / sd[t] if sd[t] else 0.0 for i, w in raw[t].items()} for t in targets}  # constant inputs weigh nothing


def fit_intercepts(df: DataFrame, scores: dict[str, list[Column]], p: float) -> dict[str, float]:
    """b with mean(sigmoid(score + b)) = p, for all targets at once.

    Newton steps inside a bracket; each step is one aggregate for all targets.
    A target may pool several score columns, whose means are averaged. Only the
    score columns are kept for the passes, in a table written once.
    """
    names = list(scores)
    flat = {f"z{i}_{j}": z for i, t in enumerate(names) for j, z in enumerate(scores[t])}
    df = written(df.select(*[z.alias(name) for name, z in flat.items()]))
    scores = {t: [F.col(f"z{i}_{j}") for j in range(len(scores[t]))] for i, t in enumerate(names)}
    centre = df.agg(*[_pooled([F.avg(s) for s in scores[t]]).alias(t) for t in names]).first()
    start = math.log(p / (1.0 - p))
    b = {t: start - (centre[t] or 0.0) for t in names}
    names = [t for t in names if centre[t] is not None]  # without any score there is nothing to fit
    if not names:
        return {t: round(v, 9) for t, v in b.items()}
    lo, hi = {t: -100.0 for t in names}, {t: 100.0 for t in names}
    for _ in range(NEWTON_STEPS):
        aggs = []
        for t in names:
            at = [sigmoid(s + F.lit(b[t])) for s in scores[t]]
            aggs.append(_pooled([F.avg(v) for v in at]).alias(f"f_{t}"))
            aggs.append(_pooled([F.avg(v * (1.0 - v)) for v in at]).alias(f"g_{t}"))
        row = df.agg(*aggs).first()
        moved, newton = 0.0, True
        for t in names:
            gap, slope = row[f"f_{t}"] - p, row[f"g_{t}"]
            if gap > 0:
                hi[t] = min(hi[t], b[t])
            else:
                lo[t] = max(lo[t], b[t])
            step = b[t] - gap / slope if slope > 0 else math.nan
            if not lo[t] <= step <= hi[t]:
                step, newton = (lo[t] + hi[t]) / 2, False
            moved = max(moved, abs(step - b[t]))
            b[t] = step
        if newton and moved < 1e-6:
            break  # quadratic convergence: what is left is far below the rounding
    else:
        if any(hi[t] - lo[t] > 1e-9 for t in names):
            raise ArithmeticError(f"intercepts did not settle in {NEWTON_STEPS} steps")
    return {t: round(v, 9) for t, v in b.items()}


def _pooled(parts: list[Column]) -> Column:
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return total / F.lit(float(len(parts)))


def hide_mcar(features: list[str], id_col: str, p: float, seed: int, stream: str = "cell") -> dict[str, Column]:
    return {x: draw(id_col, f"{stream}:{x}", seed) < p for x in features}


def _logistic(df, inputs, targets, id_col, p, seed) -> dict[str, Column]:
    """A share ``p`` of each target's known cells: a gap in an input counts as its mean, a gap in the target stays one."""
    filled = mean_filled(df, inputs)
    w = unit_variance_weights(df, inputs, targets, seed, filled)
    z = {t: _weighted(w[t], filled) for t in targets}
    b = fit_intercepts(df, {t: [F.when(F.col(t).isNotNull(), z[t])] for t in targets}, p)
    return {t: F.col(t).isNotNull() & (draw(id_col, f"cell:{t}", seed) < sigmoid(z[t] + F.lit(b[t]))) for t in targets}


def hide_mar(df: DataFrame, features: list[str], id_col: str, p: float, p_obs: float, seed: int) -> dict[str, Column]:
    """Some columns stay complete and drive the others through a logistic model."""
    drivers = pick(features, max(int(p_obs * len(features)), 1), "drivers", seed)
    return _logistic(df, drivers, [x for x in features if x not in drivers], id_col, p, seed)


def hide_mnar_logistic(
    df: DataFrame, features: list[str], id_col: str, p: float, p_params: float, seed: int, exclude_inputs: bool = True
) -> dict[str, Column]:
    """As MAR, but the driving columns are hidden too (or every column drives every column)."""
    if not exclude_inputs:
        return _logistic(df, features, features, id_col, p, seed)
    drivers = pick(features, max(int(p_params * len(features)), 1), "drivers", seed)
    hidden = _logistic(df, drivers, [x for x in features if x not in drivers], id_col, p, seed)
    return hidden | hide_mcar(drivers, id_col, p, seed)


def hide_mnar_self(
    df: DataFrame, features: list[str], id_col: str, p: float, seed: int, per_column: bool = False
) -> dict[str, Column]:
    """A cell's own value decides. By default the intercept is fitted on all columns pooled."""
    raw = {x: gauss(f"w:{x}", seed) for x in features}
    sd = df.agg(*[F.stddev_samp(F.col(x) * F.lit(raw[x])).alias(x) for x in features], *[F.count(x).alias(f"n_{x}") for x in features]).first()
    features = [x for x in features if sd[f"n_{x}"]]  # a column without values has nothing to hide
    w = {x: raw[x] / sd[x] if sd[x] else 0.0 for x in features}  # a constant column weighs nothing
    pool = {x: [F.col(z) * F.lit(w[x]) for z in ([x] if per_column else features)] for x in features}
    b = fit_intercepts(df, pool, p)
    return {
        x: F.col(x).isNotNull() & (draw(id_col, f"cell:{x}", seed) < sigmoid(F.col(x) * F.lit(w[x]) + F.lit(b[x])))
        for x in features
    }


def hide_mnar_quantile(
    df: DataFrame,
    features: list[str],
    id_col: str,
    p: float,
    q: float,
    p_params: float,
    seed: int,
    cut: str = "both",
    mcar: bool = False,
) -> dict[str, Column]:
    """Hide values beyond a quantile, in randomly chosen columns."""
    if cut not in ("upper", "lower", "both"):
        raise ValueError("cut is one of upper, lower, both")
    chosen = pick(features, max(int(p_params * len(features)), 1), "censored", seed)
    known = df.agg(*[F.count(x).alias(x) for x in chosen]).first()

    def ranks(n: int) -> list[int]:  # among the values that are there
        low, high = max(1, int(q * n)), max(1, int((1 - q) * n))
        return {"upper": [high], "lower": [low], "both": [low, high]}[cut]

    filled = [x for x in chosen if known[x]]
    values = kth_values(written(df.select(*filled)), {x: ranks(known[x]) for x in filled}) if filled else {}
    hidden = {x: F.lit(False) for x in chosen if not known[x]}
    for x in filled:
        low, high = values[x][0], values[x][-1]
        upper, lower = F.col(x) >= F.lit(high), F.col(x) <= F.lit(low)
        beyond = {"upper": upper, "lower": lower, "both": lower | upper}[cut]
        hidden[x] = (draw(id_col, f"cell:{x}", seed) < p) & beyond
    if mcar:
        extra = hide_mcar(features, id_col, p, seed, "extra")
        hidden = {x: (hidden[x] | extra[x]) if x in hidden else extra[x] for x in features}
    return hidden


def inject(
    df: DataFrame,
    features: list[str],
    id_col: str,
    p: float,
    mechanism: str = "MCAR",
    opt: str | None = None,
    p_obs: float | None = None,
    q: float | None = None,
    seed: int = 42,
    single_precision: bool = True,
) -> Injected:
    """Dispatch on (mechanism, opt); anything unknown is MCAR.

    Rates hold for the cells that are known: a gap is never counted as hidden by the model-based mechanisms.
    """
    if single_precision:
        df = df.withColumns({x: F.col(x).cast("float").cast("double") for x in features})
    return Injected(df, list(features), rules(df, features, id_col, p, mechanism, opt, p_obs, q, seed), id_col)


def rules(
    df: DataFrame,
    features: list[str],
    id_col: str,
    p: float,
    mechanism: str = "MCAR",
    opt: str | None = None,
    p_obs: float | None = None,
    q: float | None = None,
    seed: int = 42,
) -> dict[str, Column]:
    """The fitted rule of each feature that a mechanism hides."""
    if mechanism == "MAR":
        return hide_mar(df, features, id_col, p, p_obs, seed)
    if mechanism == "MNAR" and opt == "logistic":
        return hide_mnar_logistic(df, features, id_col, p, p_obs, seed)
    if mechanism == "MNAR" and opt == "quantile":
        return hide_mnar_quantile(df, features, id_col, p, q, 1 - p_obs, seed)
    if mechanism == "MNAR" and opt == "selfmasked":
        return hide_mnar_self(df, features, id_col, p, seed)
    return hide_mcar(features, id_col, p, seed)


def presets() -> dict[str, list[dict]]:
    """Parameter sets of the study by mechanism."""
    # fixed values: rates and share of driving columns
    rates, share = [0.1, 0.2, 0.3, 0.4, 0.5], 0.3
    return {
        "MCAR": [{"p_miss": 0.1, "mechanism": "MCAR", "opt": None, "p_obs": None, "q": None}],
        "MAR": [{"p_miss": r, "mechanism": "MAR", "opt": None, "p_obs": share, "q": None} for r in rates],
        "MNAR": [{"p_miss": r, "mechanism": "MNAR", "opt": "logistic", "p_obs": share, "q": None} for r in rates],
    }


def sweep(df: DataFrame, features: list[str], id_col: str, grid: DataFrame, seed: int = 42) -> DataFrame:
    """MCAR at every rate of a small grid in one pass: rows (p_miss, id, features).

    The same draw serves all rates, so the nulls of a lower rate are among
    those of a higher one.
    """
    rates = [r[0] for r in grid.select("p_miss").distinct().orderBy("p_miss").collect()]
    spread = df.withColumn("p_miss", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return spread.select(
        "p_miss",
        id_col,
        *[F.when(draw(id_col, f"cell:{x}", seed) >= F.col("p_miss"), F.col(x)).alias(x) for x in features],
    )


def sweep_grid(df: DataFrame, features: list[str], id_col: str, grid: list[dict], seed: int = 42) -> DataFrame:
    """Every parameter set of a study's grid in one pass: rows (run, p_miss, mechanism, opt, p_obs, q, id, features).

    ``grid`` holds dicts with p_miss and any of mechanism, opt, p_obs and q, as :func:`presets` gives them; run is the place in
    it. Fitting takes a few aggregates per set; the rows are read once for all sets.
    """
    table = written(df.select(id_col, *features))
    runs = []
    for run, point in enumerate(grid):
        known = {"mechanism": "MCAR", "opt": None, "p_obs": None, "q": None} | point
        hidden = rules(table, features, id_col, known["p_miss"], known["mechanism"], known["opt"], known["p_obs"], known["q"], seed)
        injected = Injected(table, list(features), hidden, id_col)
        facts = [F.lit(run).alias("run"), F.lit(float(known["p_miss"])).alias("p_miss"), F.lit(known["mechanism"]).alias("mechanism")]
        facts += [F.lit(known["opt"]).cast("string").alias("opt"), *(F.lit(known[k]).cast("double").alias(k) for k in ("p_obs", "q"))]
        runs.append(F.struct(*facts, *[F.when(~injected.flag(x), F.col(x)).alias(x) for x in features]))
    return table.select(id_col, F.inline(F.array(*runs)))
