"""Queries: null injection, sampling, splits, imputers, neighbours, blends, lattice."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapweave.functions.draw import draw, gauss, pick
from gapweave.functions.scalar import linear, observed_mask
from gapweave.operators import blend, impute, inject, knn, lattice, metrics, sampling
from gapweave.operators.clean import Panel
from gapweave.plans.registry import query
from gapweave.plans.sqltext import FEATURES, RATES, SCORERS, SEED, sig, sql, u
from gapweave.plans.working import customer_features, incomplete, pool_frames, preds, scaled, scratch, table


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---- injection -------------------------------------------------------------


def _masks(hidden: dict[str, str]) -> str:
    return ", ".join(f"({hidden.get(x, 'false')}) AS m_{x}" for x in FEATURES)


def _flags(hidden, spark, sf):
    inj = inject.Injected(scaled(spark, sf), FEATURES, hidden, "row_id")
    return inj.mask


def _cell(x: str) -> str:
    return u("row_id", f"cell:{x}")


@query("inject_mcar", sql(["cfs"], f"SELECT row_id, {_masks({x: _cell(x) + ' < 0.3' for x in FEATURES})} FROM cfs"))
def _(spark, sf):
    return _flags(inject.hide_mcar(FEATURES, "row_id", 0.3, SEED), spark, sf)


def _newton(scores: dict[str, list[str]], p: float, src: str, steps: int = 12) -> list[tuple[str, str]]:
    """Chained steps that solve mean(sigmoid(score + b)) = p for every target."""
    import math

    def mean(parts):
        return "(" + " + ".join(f"avg({x})" for x in parts) + f") / {len(parts)}.0"

    start = math.log(p / (1 - p))
    out = [("b0", "SELECT " + ", ".join(f"{start!r}::DOUBLE - {mean(s)} AS b_{t}" for t, s in scores.items()) + f" FROM {src}")]
    for k in range(steps):
        terms = []
        for t, s in scores.items():
            at = [sig(f"{x} + b_{t}") for x in s]
            slope = [f"{v} * (1.0 - {v})" for v in at]
            terms.append(f"max(b_{t}) - ({mean(at)} - {p}::DOUBLE) / ({mean(slope)}) AS b_{t}")
        out.append((f"b{k + 1}", f"SELECT {', '.join(terms)} FROM {src}, b{k}"))
    final = ", ".join(f"round(b_{t}, 9) AS b_{t}" for t in scores)
    return [*out, ("bb", f"SELECT {final} FROM b{steps}")]


def _logistic_sql(drivers: list[str], targets: list[str], p: float) -> tuple[list[tuple[str, str]], dict[str, str]]:
    raw = {t: " + ".join(f"{x} * ({gauss(f'w:{x}:{t}', SEED)!r}::DOUBLE)" for x in drivers) for t in targets}
    sd = ("sd", "SELECT " + ", ".join(f"stddev_samp({raw[t]}) AS sd_{t}" for t in targets) + " FROM cfs")
    z = ("z", "SELECT row_id, " + ", ".join(
        " + ".join(f"{x} * ({gauss(f'w:{x}:{t}', SEED)!r}::DOUBLE / sd_{t})" for x in drivers) + f" AS z_{t}" for t in targets) + " FROM cfs, sd")
    steps = _newton({t: [f"z_{t}"] for t in targets}, p, "z")
    hidden = {t: f"{_cell(t)} < {sig(f'z_{t} + b_{t}')}" for t in targets}
    return [sd, z, *steps], hidden


_DRIVERS = pick(FEATURES, 1, "drivers", SEED)
_OTHERS = [x for x in FEATURES if x not in _DRIVERS]
_MAR_STEPS, _MAR_HIDDEN = _logistic_sql(_DRIVERS, _OTHERS, 0.3)
_ALL_STEPS, _ALL_HIDDEN = _logistic_sql(FEATURES, FEATURES, 0.3)


@query("inject_mar", sql(["cfs"], f"SELECT row_id, {_masks(_MAR_HIDDEN)} FROM z, bb", _MAR_STEPS))
def _(spark, sf):
    df = scaled(spark, sf)
    return _flags(inject.hide_mar(df, FEATURES, "row_id", 0.3, 0.3, SEED), spark, sf)


@query(
    "inject_mnar_logistic",
    sql(["cfs"], f"SELECT row_id, {_masks(_MAR_HIDDEN | {x: _cell(x) + ' < 0.3' for x in _DRIVERS})} FROM z, bb", _MAR_STEPS),
)
def _(spark, sf):
    df = scaled(spark, sf)
    return _flags(inject.hide_mnar_logistic(df, FEATURES, "row_id", 0.3, 0.3, SEED), spark, sf)


@query("inject_mnar_logistic_all", sql(["cfs"], f"SELECT row_id, {_masks(_ALL_HIDDEN)} FROM z, bb", _ALL_STEPS))
def _(spark, sf):
    df = scaled(spark, sf)
    return _flags(inject.hide_mnar_logistic(df, FEATURES, "row_id", 0.3, 0.3, SEED, exclude_inputs=False), spark, sf)


def _self_sql(p: float):
    raw = {x: repr(gauss(f"w:{x}", SEED)) for x in FEATURES}
    sd = ("sd", "SELECT " + ", ".join(f"{raw[x]}::DOUBLE / stddev_samp({x} * {raw[x]}::DOUBLE) AS c_{x}" for x in FEATURES) + " FROM cfs")
    z = ("z", "SELECT * FROM cfs, sd")
    steps = _newton({x: [f"{k} * c_{x}" for k in FEATURES] for x in FEATURES}, p, "z")
    return [sd, z, *steps], {x: f"{_cell(x)} < {sig(f'{x} * c_{x} + b_{x}')}" for x in FEATURES}


_SELF_STEPS, _SELF_HIDDEN = _self_sql(0.3)


@query("inject_mnar_selfmask", sql(["cfs"], f"SELECT row_id, {_masks(_SELF_HIDDEN)} FROM z, bb", _SELF_STEPS))
def _(spark, sf):
    df = scaled(spark, sf)
    return _flags(inject.hide_mnar_self(df, FEATURES, "row_id", 0.3, SEED), spark, sf)


def _rank_value(x: str, q: str) -> str:
    return f"(SELECT {x} FROM (SELECT {x}, row_number() OVER (ORDER BY {x}) AS r FROM cfs) WHERE r = greatest(1, CAST(floor({q} * (SELECT count(*) FROM cfs)) AS BIGINT)))"


_CENSORED = pick(FEATURES, 2, "censored", SEED)


@query(
    "inject_mnar_quantile",
    sql(["cfs"], "SELECT row_id, " + _masks({
        x: f"{_cell(x)} < 0.5 AND ({x} <= {_rank_value(x, '0.25::DOUBLE')} OR {x} >= {_rank_value(x, '0.75::DOUBLE')})" for x in _CENSORED}) + " FROM cfs"),
)
def _(spark, sf):
    df = scaled(spark, sf)
    hidden = inject.hide_mnar_quantile(df, FEATURES, "row_id", 0.5, 0.25, 0.7, SEED)
    return _flags(hidden, spark, sf)


@query(
    "inject_mnar_quantile_upper",
    sql(["cfs"], "SELECT row_id, " + _masks({
        x: (f"({_cell(x)} < 0.5 AND {x} >= {_rank_value(x, '0.75::DOUBLE')}) OR " if x in _CENSORED else "") + u("row_id", f"extra:{x}") + " < 0.5" for x in FEATURES}) + " FROM cfs"),
)
def _(spark, sf):
    df = scaled(spark, sf)
    hidden = inject.hide_mnar_quantile(df, FEATURES, "row_id", 0.5, 0.25, 0.7, SEED, cut="upper", mcar=True)
    return _flags(hidden, spark, sf)


@query(
    "inject",
    sql(["cfs"], "SELECT row_id, " + ", ".join(
        f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 9) AS {x}_init, CASE WHEN {_cell(x)} >= 0.1 THEN round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 9) END AS {x}_incomp, {_cell(x)} < 0.1 AS m_{x}"
        for x in FEATURES) + " FROM cfs"),
)
def _(spark, sf):
    inj = inject.inject(scaled(spark, sf), FEATURES, "row_id", **_preset("MCAR"), seed=SEED).with_flags()
    out = inj.withColumnsRenamed({x: f"{x}_init" for x in FEATURES} | {f"x_{x}": f"{x}_incomp" for x in FEATURES})
    cols = [c for x in FEATURES for c in (f"{x}_init", f"{x}_incomp")]
    return rounded(out, cols, 9).select("row_id", *cols, *[f"m_{x}" for x in FEATURES])


def _preset(name: str) -> dict:
    chosen = dict(inject.presets()[name][0])
    chosen["p"] = chosen.pop("p_miss")
    return chosen


# the same mechanisms on a table that holds gaps: rates over known cells, a driver's gap counts as its mean


def _gap_masks(hidden: dict[str, str]) -> str:
    return ", ".join(f"coalesce({hidden.get(x, 'false')}, false) AS m_{x}" for x in FEATURES)


def _gap_logistic(drivers: list[str], targets: list[str], p: float) -> tuple[list[tuple[str, str]], dict[str, str]]:
    raw = {t: " + ".join(f"f_{x} * ({gauss(f'w:{x}:{t}', SEED)!r}::DOUBLE)" for x in drivers) for t in targets}
    fu = ("fu", "SELECT cfm.*, " + ", ".join(f"coalesce({x}, avg({x}) OVER ()) AS f_{x}" for x in drivers) + " FROM cfm")
    sd = ("sd", "SELECT " + ", ".join(f"stddev_samp({raw[t]}) AS sd_{t}" for t in targets) + " FROM fu")
    z = ("z", "SELECT fu.*, " + ", ".join(
        f"CASE WHEN {t} IS NOT NULL THEN " + " + ".join(f"f_{x} * ({gauss(f'w:{x}:{t}', SEED)!r}::DOUBLE / sd_{t})" for x in drivers) + f" END AS z_{t}" for t in targets) + " FROM fu, sd")
    return [fu, sd, z, *_newton({t: [f"z_{t}"] for t in targets}, p, "z")], {t: f"{_cell(t)} < {sig(f'z_{t} + b_{t}')}" for t in targets}


def _gap_self(p: float) -> tuple[list[tuple[str, str]], dict[str, str]]:
    steps, hidden = _self_sql(p)
    return [(n, t.replace("FROM cfs", "FROM cfm")) for n, t in steps], hidden


def _gap_rank(x: str, q: str) -> str:
    return f"(SELECT {x} FROM (SELECT {x}, row_number() OVER (ORDER BY {x}) AS r FROM cfm WHERE {x} IS NOT NULL) WHERE r = greatest(1, CAST(floor({q} * (SELECT count({x}) FROM cfm)) AS BIGINT)))"


_GAP_SETS = {
    "inject_mar_gaps": ({"p": 0.3, "mechanism": "MAR", "p_obs": 0.3}, *_gap_logistic(_DRIVERS, _OTHERS, 0.3)),
    "inject_mnar_selfmask_gaps": ({"p": 0.2, "mechanism": "MNAR", "opt": "selfmasked"}, *_gap_self(0.2)),
    "inject_mnar_quantile_gaps": (
        {"p": 0.5, "mechanism": "MNAR", "opt": "quantile", "p_obs": 0.3, "q": 0.25}, [],
        {x: f"{_cell(x)} < 0.5 AND ({x} <= {_gap_rank(x, '0.25::DOUBLE')} OR {x} >= {_gap_rank(x, '0.75::DOUBLE')})" for x in _CENSORED},
    ),
}
_GAP_SETS["inject_mnar_logistic_gaps"] = (
    {"p": 0.3, "mechanism": "MNAR", "opt": "logistic", "p_obs": 0.3}, _GAP_SETS["inject_mar_gaps"][1],
    _GAP_SETS["inject_mar_gaps"][2] | {x: _cell(x) + " < 0.3" for x in _DRIVERS},
)


def _gap_sql(name: str, columns: str) -> str:
    _, steps, hidden = _GAP_SETS[name]
    return sql(["cfm"], f"SELECT {columns} FROM (SELECT *, {_gap_masks(hidden)} FROM {'z, bb' if steps else 'cfm'})", steps)


def _gap_query(name: str) -> None:
    @query(name, _gap_sql(name, "row_id, " + ", ".join(f"m_{x}" for x in FEATURES)))
    def _(spark, sf):
        return inject.inject(incomplete(spark, sf), FEATURES, "row_id", **_GAP_SETS[name][0], seed=SEED, single_precision=False).mask


for _name in _GAP_SETS:
    _gap_query(_name)


@query("inject_mnar_logistic_all_gaps", (lambda made: sql(["cfm"], f"SELECT row_id, {_gap_masks(made[1])} FROM z, bb", made[0]))(_gap_logistic(FEATURES, FEATURES, 0.3)))
def _(spark, sf):
    df = incomplete(spark, sf)
    hidden = inject.hide_mnar_logistic(df, FEATURES, "row_id", 0.3, 0.3, SEED, exclude_inputs=False)
    return inject.Injected(df, FEATURES, hidden, "row_id").mask


_RAW3 = {t: " + ".join(f"{x} * ({gauss(f'w:{x}:{t}', SEED)!r}::DOUBLE)" for x in _DRIVERS) for t in _OTHERS}


@query(
    "coeff_unit_variance",
    sql(["cfs"], " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{x}' AS input, round({gauss(f'w:{x}:{t}', SEED)!r}::DOUBLE / stddev_samp({_RAW3[t]}), 6) AS w FROM cfs" for t in _OTHERS for x in _DRIVERS)),
)
def _(spark, sf):
    w = inject.unit_variance_weights(scaled(spark, sf), _DRIVERS, _OTHERS, SEED)
    rows = [(t, x, v) for t, by in w.items() for x, v in by.items()]
    return rounded(spark.createDataFrame(rows, "target string, input string, w double"), ["w"])


@query("fit_intercepts", sql(["cfs"], " UNION ALL ".join(f"SELECT '{t}' AS target, round(b_{t}, 6) AS b FROM bb" for t in _OTHERS), _MAR_STEPS))
def _(spark, sf):
    df = scaled(spark, sf)
    w = inject.unit_variance_weights(df, _DRIVERS, _OTHERS, SEED)
    b = inject.fit_intercepts(df, {t: [linear(w[t])] for t in _OTHERS}, 0.3)
    return rounded(spark.createDataFrame(list(b.items()), "target string, b double"), ["b"])


@query(
    "injection_presets",
    sql(["cfs"], "SELECT mechanism, opt, p_miss, p_obs, n_features * count(*) AS n_cells FROM cfs, (VALUES ('MCAR', NULL, 0.1::DOUBLE, NULL::DOUBLE, 3), "
        + ", ".join(f"('MAR', NULL, {r}, 0.3, 2)" for r in (0.1, 0.2, 0.3, 0.4, 0.5)) + ", "
        + ", ".join(f"('MNAR', 'logistic', {r}, 0.3, 3)" for r in (0.1, 0.2, 0.3, 0.4, 0.5))
        + ") g(mechanism, opt, p_miss, p_obs, n_features) GROUP BY mechanism, opt, p_miss, p_obs, n_features"),
)
def _(spark, sf):
    rows = [(g["mechanism"], g["opt"], g["p_miss"], g["p_obs"], 2 if m == "MAR" else 3) for m, gs in inject.presets().items() for g in gs]
    # the preset list rides along with each row, to show how many cells a preset may hide
    presets = F.array(*[F.struct(F.lit(a).alias("mechanism"), F.lit(b).cast("string").alias("opt"), F.lit(c).alias("p_miss"),
                                 F.lit(d).cast("double").alias("p_obs"), F.lit(k).cast("long").alias("k")) for a, b, c, d, k in rows])
    spread = scaled(spark, sf).select(F.inline(presets))
    return spread.groupBy("mechanism", "opt", "p_miss", "p_obs").agg(F.sum("k").alias("n_cells"))


@query(
    "inject_panel_rows",
    sql(["cfs"], f"SELECT row_id, CASE WHEN r > floor(c * 0.4) THEN round(a, 9) END AS a, CASE WHEN r > floor(c * 0.4) THEN round(s, 9) END AS s, round(n, 9) AS n FROM (SELECT *, row_number() OVER (ORDER BY {u('row_id', 'panel', 7)}, row_id) AS r, count(*) OVER () AS c FROM cfs)"),
)
def _(spark, sf):
    df = scaled(spark, sf).select("row_id", *FEATURES)
    return rounded(sampling.hide_panel_rows(df, ["a", "s"], "row_id", fraction=0.4, seed=7), FEATURES, 9)


@query(
    "inject_fixed_count",
    sql(["cfs"], "SELECT row_id, " + ", ".join(
        f"CASE WHEN row_number() OVER (ORDER BY {u('row_id', 'count:' + x, 7)}, row_id) > floor(0.1 * count(*) OVER ()) THEN round({x}, 9) END AS {x}" for x in FEATURES) + " FROM cfs"),
)
def _(spark, sf):
    df = scaled(spark, sf).select("row_id", *FEATURES)
    return rounded(sampling.hide_fixed_count(df, FEATURES, "row_id", 0.1, 7), FEATURES, 9)


@query(
    "sweep_injection",
    sql(["swept"], " UNION ALL ".join(f"SELECT rate / 100.0::DOUBLE AS p_miss, '{x}' AS feature, count(*) FILTER ({x} IS NULL) AS nulls FROM swept GROUP BY rate" for x in FEATURES)),
)
def _(spark, sf):
    grid = spark.createDataFrame([(r / 100.0,) for r in RATES], "p_miss double")
    swept = inject.sweep(scaled(spark, sf), FEATURES, "row_id", grid, SEED)
    counts = swept.groupBy("p_miss").agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in FEATURES])
    return counts.unpivot(["p_miss"], FEATURES, "feature", "nulls")


_GRID = [p | {"p_miss": p["p"]} for p, _, _ in _GAP_SETS.values()]


def _grid_sql() -> str:
    parts = []
    for run, (name, (p, _, _)) in enumerate(_GAP_SETS.items()):
        left = ", ".join(f"CASE WHEN NOT m_{x} THEN {x} END AS {x}" for x in FEATURES)
        quoted = [f"'{p[k]}'" if isinstance(p.get(k), str) else f"{p[k]}::DOUBLE" if k in p else "NULL" for k in ("mechanism", "opt", "p_obs", "q")]
        facts = f"{run} AS run, {p['p']}::DOUBLE AS p_miss, {quoted[0]} AS mechanism, {quoted[1]}::VARCHAR AS opt, {quoted[2]}::DOUBLE AS p_obs, {quoted[3]}::DOUBLE AS q"
        counts = " UNION ALL ".join(f"SELECT '{x}' AS feature, count(*) FILTER ({x} IS NULL) AS nulls FROM t" for x in FEATURES)
        parts.append(f"SELECT {facts}, c.* FROM (WITH t AS ({_gap_sql(name, left)}) {counts}) c")
    return " UNION ALL ".join(parts)


@query("sweep_injection_grid", _grid_sql())
def _(spark, sf):
    swept = inject.sweep_grid(incomplete(spark, sf), FEATURES, "row_id", _GRID, SEED)
    facts = ["run", "p_miss", "mechanism", "opt", "p_obs", "q"]
    counts = swept.groupBy(*facts).agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in FEATURES])
    return counts.unpivot(facts, FEATURES, "feature", "nulls")


# ---- sampling and splits ---------------------------------------------------


@query(
    "undersample",
    sql(["cf"], f"SELECT row_id, y FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {u('row_id', 'under', 0)}, row_id) AS r FROM cf) WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM cf GROUP BY y))"),
)
def _(spark, sf):
    return sampling.undersample(customer_features(spark, sf), "y", "row_id").select("row_id", "y")


_OVER = [
    ("sz", "SELECT y, count(*) AS n FROM cf GROUP BY y"),
    ("top", "SELECT max(n) AS top FROM sz"),
    ("rk", f"SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {u('row_id', 'over', 0)}, row_id) AS r FROM cf"),
    ("ex", "SELECT y, n, unnest(range(1, top - n + 1)) AS copy FROM sz, top WHERE n < top"),
    ("pk", f"SELECT y, copy, CAST(floor({u('y || chr(58) || copy', 'over-pick', 0)} * n) AS BIGINT) + 1 AS r FROM ex"),
]


@query("oversample", sql(["cf"], "SELECT row_id, y, 0::BIGINT AS copy FROM cf UNION ALL SELECT rk.row_id, rk.y, copy FROM pk JOIN rk USING (y, r)", _OVER))
def _(spark, sf):
    return sampling.oversample(customer_features(spark, sf), "y", "row_id").select("row_id", "y", "copy")


@query("oversample_union", sql(["cf"], "SELECT y, count(*) AS n FROM (SELECT y FROM cf UNION ALL SELECT rk.y FROM pk JOIN rk USING (y, r)) GROUP BY y", _OVER))
def _(spark, sf):
    return metrics.class_counts(sampling.oversample(customer_features(spark, sf), "y", "row_id"), ["y"])


_FOLDS = f"SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {u('row_id', 'fold')}, row_id) - 1) % 5 AS INTEGER) AS fold FROM cf"


@query("stratified_folds", sql(["cf"], _FOLDS))
def _(spark, sf):
    return sampling.stratified_folds(customer_features(spark, sf), "row_id", "y", 5, SEED)


@query(
    "train_val_cut",
    sql(["cf"], f"""SELECT fold, row_id, CASE WHEN r <= floor(c * 0.5) THEN 'train' ELSE 'val' END AS role FROM
    (SELECT k AS fold, row_id, row_number() OVER (PARTITION BY k ORDER BY {u("k || ':' || row_id", 'cut')}, row_id) AS r, count(*) OVER (PARTITION BY k) AS c FROM fo, range(5) t(k) WHERE fold <> k)
    UNION ALL SELECT fold, row_id, 'test' FROM fo""", [("fo", _FOLDS)]),
)
def _(spark, sf):
    folds = sampling.stratified_folds(customer_features(spark, sf), "row_id", "y", 5, SEED)
    return sampling.fold_roles(folds, "row_id", 5, 0.5, SEED)


@query("split_hook", sql(["cf"], "SELECT row_id, CAST(row_id % 5 AS INTEGER) AS fold, 'test' AS role FROM cf"))
def _(spark, sf):
    rule = lambda df: df.select("row_id", (F.col("row_id") % 5).cast("int").alias("fold"), F.lit("test").alias("role"))
    return sampling.custom_split(customer_features(spark, sf), rule)


_SUBJ = "SELECT user_id, max(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS y FROM events GROUP BY user_id"


@query(
    "split_grouped",
    sql([], f"""SELECT fold, user_id, CASE WHEN r <= floor(c / 2.0) THEN 'train' ELSE 'val' END AS role FROM
    (SELECT k AS fold, user_id, row_number() OVER (PARTITION BY k, y ORDER BY {u("k || ':' || user_id", 'group-cut')}, user_id) AS r, count(*) OVER (PARTITION BY k, y) AS c FROM ow, range(5) t(k) WHERE own <> k)
    UNION ALL SELECT own, user_id, 'test' FROM ow""",
        [("su", _SUBJ), ("ow", f"SELECT user_id, y, (row_number() OVER (PARTITION BY y ORDER BY {u('user_id', 'group-fold')}, user_id) - 1) % 5 AS own FROM su")]),
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("y", (F.col("user_id") % 2 == 0).cast("int"))
    return sampling.split_grouped(e, "user_id", "y", 5, SEED)


@query("split_random", f"SELECT o_orderkey, CASE WHEN {u('o_orderkey', 'split')} < 0.3 THEN 'test' ELSE 'train' END AS role FROM orders")
def _(spark, sf):
    return sampling.split_random(table(spark, sf, "orders"), "o_orderkey", 0.3, SEED).select("o_orderkey", "role")


@query(
    "split_ids_half",
    f"SELECT user_id, CASE WHEN r <= floor(c / 2.0) THEN 'train' ELSE 'val' END AS role FROM (SELECT user_id, row_number() OVER (ORDER BY {u('user_id', 'half')}, user_id) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT user_id FROM events))",
)
def _(spark, sf):
    return sampling.split_ids_half(table(spark, sf, "events"), "user_id", SEED)


# ---- imputers --------------------------------------------------------------


@query("impute_mean", sql(["cfm", "mu"], "SELECT row_id, " + ", ".join(f"round(coalesce(cfm.{x}, mu.{x}), 9) AS {x}" for x in FEATURES) + " FROM cfm, mu"))
def _(spark, sf):
    cfm = incomplete(spark, sf)
    out = impute.MeanImputer(FEATURES).fit(cfm.filter("role = 'train'")).transform(cfm)
    return rounded(out.select("row_id", *FEATURES), FEATURES, 9)


_HID = {x: u("l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber", f"cell:{x}") for x in ("l_quantity", "l_discount")}


@query(
    "impute_mode",
    sql([], """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(q, (SELECT q FROM li WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)) AS l_quantity,
    coalesce(d, (SELECT d FROM li WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1)) AS l_discount FROM li""",
        [("li", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN {_HID['l_quantity']} >= 0.2 THEN l_quantity END AS q, CASE WHEN {_HID['l_discount']} >= 0.2 THEN l_discount END AS d FROM lineitem")]),
)
def _(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    key = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    cols = ["l_quantity", "l_discount"]
    li = table(spark, sf, "lineitem").select(
        *keys, *[F.when(draw(key, f"cell:{x}", SEED) >= 0.2, F.col(x)).alias(x) for x in cols]
    )
    return impute.ModeImputer(cols).fit(li).transform(li)


@query("impute_identity", sql(["cfm"], "SELECT row_id, " + ", ".join(f"round({x}, 9) AS {x}" for x in FEATURES) + " FROM cfm"))
def _(spark, sf):
    cfm = incomplete(spark, sf).select("row_id", *FEATURES)
    return rounded(impute.IdentityImputer().fit(cfm).transform(cfm), FEATURES, 9)


def _knn_sql(k: int, weighted: bool) -> str:
    have = " + ".join(f"(CASE WHEN q.{x} IS NULL OR v.{x} IS NULL THEN 0 ELSE 1 END)" for x in FEATURES)
    sq = " + ".join(f"coalesce((q.{x} - v.{x}) * (q.{x} - v.{x}), 0)" for x in FEATURES)
    extra = [("tr", "SELECT * FROM cfm WHERE role = 'train'"), ("me", "SELECT " + ", ".join(f"avg({x}) AS {x}" for x in FEATURES) + " FROM tr")]
    for x in FEATURES:
        value = (
            "CASE WHEN count(*) FILTER (d = 0) > 0 THEN avg(v) FILTER (d = 0) ELSE sum(v / nullif(d, 0)) / sum(1.0 / nullif(d, 0)) END"
            if weighted else "avg(v)"
        )
        extra.append((f"f_{x}", f"""SELECT row_id, {value} AS f FROM (SELECT q.row_id, v.{x} AS v, round(sqrt(({sq}) * 3.0 / nullif({have}, 0)), 9) AS d, v.row_id AS vid
            FROM cfm q JOIN tr v ON q.{x} IS NULL AND v.{x} IS NOT NULL WHERE ({have}) > 0 QUALIFY row_number() OVER (PARTITION BY q.row_id ORDER BY d, vid) <= {k}) GROUP BY row_id"""))
    cols = ", ".join(f"round(coalesce(cfm.{x}, f_{x}.f, me.{x}), 6) AS {x}" for x in FEATURES)
    joins = " ".join(f"LEFT JOIN f_{x} ON f_{x}.row_id = cfm.row_id" for x in FEATURES)
    return sql(["cfm"], f"SELECT cfm.row_id, {cols} FROM cfm CROSS JOIN me {joins}", extra)


@query("impute_knn", _knn_sql(5, False))
def _(spark, sf):
    cfm = incomplete(spark, sf)
    model = impute.KnnImputer(FEATURES, "row_id", 5).fit(cfm.filter("role = 'train'"))
    return rounded(model.transform(cfm, "row_id").select("row_id", *FEATURES), FEATURES)


@query("impute_knn_weighted", _knn_sql(5, True))
def _(spark, sf):
    cfm = incomplete(spark, sf)
    model = impute.KnnImputer(FEATURES, "row_id", 5, weighted=True).fit(cfm.filter("role = 'train'"))
    return rounded(model.transform(cfm, "row_id").select("row_id", *FEATURES), FEATURES)


@query("impute_knn_partitioned", _knn_sql(5, False))
def _(spark, sf):
    cfm = incomplete(spark, sf)
    model = impute.KnnImputer(FEATURES, "row_id", 5, max_cells=0).fit(cfm.filter("role = 'train'"))
    return rounded(model.transform(cfm, "row_id").select("row_id", *FEATURES), FEATURES)


# one round, one column, fixed strength: ridge of s on (a, n) over mean-filled rows
@query(
    "impute_ridge_step",
    sql(["cfm"], """SELECT row_id, round(coalesce(s, ym + wa * (fa - am) + wn * (fn - nm)), 6) AS s FROM fl, wt""",
        [("me", "SELECT avg(a) AS a, avg(n) AS n FROM cfm"),
         ("fl", "SELECT row_id, coalesce(cfm.a, me.a) AS fa, coalesce(cfm.n, me.n) AS fn, s FROM cfm, me"),
         ("mm", "SELECT avg(fa) AS am, avg(fn) AS nm, avg(s) AS ym FROM fl WHERE s IS NOT NULL"),
         ("gr", "SELECT am, nm, ym, sum((fa - am) * (fa - am)) + 1.0 AS aa, sum((fn - nm) * (fn - nm)) + 1.0 AS nn, sum((fa - am) * (fn - nm)) AS an, sum((fa - am) * (s - ym)) AS ay, sum((fn - nm) * (s - ym)) AS ny FROM fl, mm WHERE s IS NOT NULL GROUP BY am, nm, ym"),
         ("wt", "SELECT am, nm, ym, (ay * nn - ny * an) / (aa * nn - an * an) AS wa, (ny * aa - ay * an) / (aa * nn - an * an) AS wn FROM gr")]),
)
def _(spark, sf):
    cfm = incomplete(spark, sf)
    model = impute.IterativeRidgeImputer(FEATURES, rounds=1, bayes=False, strength=1.0, targets=["s"]).fit(cfm)
    return rounded(model.transform(cfm).select("row_id", "s"), ["s"])


def _ridge_sql(rounds: int) -> str:
    """Round-robin ridge of strength 1, column after column: each step reads the rows as the step before left them."""
    out = [
        ("me", "SELECT " + ", ".join(f"avg({x}) AS {x}" for x in FEATURES) + " FROM cfm WHERE role = 'train'"),
        ("r0", "SELECT row_id, role, " + ", ".join(f"coalesce(cfm.{x}, me.{x}) AS {x}, cfm.{x} IS NULL AS g_{x}" for x in FEATURES) + " FROM cfm, me"),
    ]
    for k in range(rounds * len(FEATURES)):
        t = FEATURES[k % len(FEATURES)]
        p, q = [x for x in FEATURES if x != t]
        seen = f"FROM r{k}, m{k} WHERE role = 'train' AND NOT g_{t} GROUP BY pm, qm, tm"
        out += [
            (f"m{k}", f"SELECT avg({p}) AS pm, avg({q}) AS qm, avg({t}) AS tm FROM r{k} WHERE role = 'train' AND NOT g_{t}"),
            (f"s{k}", f"SELECT pm, qm, tm, sum(({p} - pm) * ({p} - pm)) + 1.0 AS pp, sum(({q} - qm) * ({q} - qm)) + 1.0 AS qq, sum(({p} - pm) * ({q} - qm)) AS pq, sum(({p} - pm) * ({t} - tm)) AS pt, sum(({q} - qm) * ({t} - tm)) AS qt {seen}"),
            (f"r{k + 1}", f"SELECT row_id, role, {', '.join(f'g_{x}' for x in FEATURES)}, {p}, {q}, CASE WHEN g_{t} THEN tm + (pt * qq - qt * pq) / (pp * qq - pq * pq) * ({p} - pm) + (qt * pp - pt * pq) / (pp * qq - pq * pq) * ({q} - qm) ELSE {t} END AS {t} FROM r{k}, s{k}"),
        ]
    return sql(["cfm"], f"SELECT row_id, {', '.join(f'round({x}, 6) AS {x}' for x in FEATURES)} FROM r{rounds * len(FEATURES)}", out)


@query("impute_iter_ridge_rounds", _ridge_sql(10))
def _(spark, sf):
    cfm = incomplete(spark, sf)
    ridge = impute.IterativeRidgeImputer(FEATURES, rounds=10, tolerance=0.0, bayes=False, strength=1.0, order="roman")
    return rounded(ridge.fit(cfm.filter("role = 'train'")).transform(cfm).select("row_id", *FEATURES), FEATURES)


@query("impute_iter_ridge")
def _(spark, sf):
    cfm = incomplete(spark, sf)
    model = impute.IterativeRidgeImputer(FEATURES, rounds=10).fit(cfm.filter("role = 'train'"))
    return rounded(model.transform(cfm).select("row_id", *FEATURES), FEATURES)


@query(
    "impute_store",
    sql(["cfm", "mu"], "SELECT role, count(*) AS n_rows, " + ", ".join(f"round(avg(coalesce(cfm.{x}, mu.{x})), 6) AS {x}" for x in FEATURES) + " FROM cfm, mu GROUP BY role"),
)
def _(spark, sf):
    from gapweave.sources.writers import write_run_tables

    cfm = incomplete(spark, sf)
    filled = impute.MeanImputer(FEATURES).fit(cfm.filter("role = 'train'")).transform(cfm)
    paths = write_run_tables({"imputed": filled.withColumn("member", F.lit("mean"))}, scratch(spark, "imputed"), ["member"])
    back = spark.read.parquet(paths["imputed"]).filter("member = 'mean'")
    return rounded(back.groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(x).alias(x) for x in FEATURES]), FEATURES)


# ---- neighbours and blends -------------------------------------------------

_SQD = " + ".join(f"(t.{x} - v.{x}) * (t.{x} - v.{x})" for x in FEATURES)
_NEAR = f"""SELECT t.row_id, t.idx, t.model, t.p, v.row_id AS val_id, v.y AS vy, v.p AS vp, round(sqrt({_SQD}), 9) AS dist FROM preds t JOIN preds v ON t.model = v.model
    WHERE t.role = 'test' AND v.role = 'val' QUALIFY row_number() OVER (PARTITION BY t.row_id, t.model ORDER BY round(sqrt({_SQD}), 9), v.row_id) <= 7"""
_COMP = "SELECT row_id, idx, model, any_value(p) AS p, round(avg(1 - CASE WHEN vy = 1 THEN 1 - vp ELSE vp END), 9) AS c FROM near GROUP BY row_id, idx, model"
_COMP_R = "SELECT row_id, idx, model, any_value(p) AS p, round(-avg(abs(vy - vp)), 9) AS c FROM near GROUP BY row_id, idx, model"


def _dew_sql(comp: str, top_n: list[int], threshold: float | None, src: list[tuple[str, str]]) -> tuple[str, list]:
    cut = f"CASE WHEN c > {threshold} THEN c ELSE 0 END" if threshold is not None else "c"
    steps = [
        *src,
        ("comp", comp),
        ("rk", "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, idx) AS r FROM comp"),
        ("sel", f"SELECT top_n, row_id, idx, model, p, {cut} AS c FROM rk, (VALUES {', '.join(f'({n})' for n in top_n)}) t(top_n) WHERE top_n = 0 OR r <= top_n"),
        ("ww", "SELECT *, exp(c) / sum(exp(c)) OVER (PARTITION BY top_n, row_id) AS w FROM sel"),
    ]
    return "SELECT row_id, CAST(top_n AS INTEGER) AS top_n, round(sum(w * p), 6) AS blend FROM ww GROUP BY row_id, top_n", steps


def _pool(spark, sf):
    out = []
    for _, name, df in pool_frames(spark, sf):
        df = df.withColumn("y", F.col("y").cast("double"))
        out.append(blend.PoolMember(name, df.filter("role = 'val'"), df.filter("role = 'test'")))
    return out


@query("knn_join", sql(["preds"], "SELECT row_id, model, val_id, dist, CAST(row_number() OVER (PARTITION BY row_id, model ORDER BY dist, val_id) AS INTEGER) AS rank FROM near", [("near", _NEAR)]))
def _(spark, sf):
    near = blend.neighbours(_pool(spark, sf), FEATURES, 7)
    return near.select("row_id", "model", "val_id", "dist", "rank")


@query(
    "knn_join_partitioned",
    sql(["cfs"], f"""SELECT row_id, val_id, dist, CAST(r AS INTEGER) AS rank FROM (SELECT t.row_id, v.row_id AS val_id, round(sqrt({_SQD}), 9) AS dist,
    row_number() OVER (PARTITION BY t.row_id ORDER BY round(sqrt({_SQD}), 9), v.row_id) AS r FROM cfs t JOIN cfs v ON t.role = 'test' AND v.role <> 'test') WHERE r <= 5"""),
)
def _(spark, sf):
    # the form for a reference side of any size: cells around pivots
    df = scaled(spark, sf)
    pairs = knn.knn_join(df.filter("role = 'test'"), df.filter("role <> 'test'"), FEATURES, 5, max_cells=0, pivots=32)
    return pairs.select("row_id", "val_id", "dist", "rank")


@query(
    "knn_join_embeddings",
    sql([], """SELECT q.vec_id, v.vec_id AS val_id, v.label::DOUBLE AS label, round(sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS dist
    FROM em q JOIN em v ON true QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY
    round(sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9), v.vec_id) <= 5""",
        [("em", "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings")]),
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    d = 64  # width of the embeddings
    wide = e.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(d)])
    pairs = knn.knn_join(
        wide, wide, [f"e{i}" for i in range(d)], 5,
        query_id="vec_id", ref_id="vec_id", payload=["label"],
    )
    return rounded(pairs.select("vec_id", "val_id", "label", "dist"), ["dist"])


@query("topk_neighbours", sql(["preds"], "SELECT row_id, model, val_id, dist FROM near QUALIFY row_number() OVER (PARTITION BY row_id, model ORDER BY dist, val_id) <= 3", [("near", _NEAR)]))
def _(spark, sf):
    near = blend.neighbours(_pool(spark, sf), FEATURES, 3)
    return near.select("row_id", "model", "val_id", "dist")


@query("competence_classify", sql(["preds"], "SELECT row_id, model, c FROM comp", [("near", _NEAR), ("comp", _COMP)]))
def _(spark, sf):
    return blend.competences(blend.neighbours(_pool(spark, sf), FEATURES, 7)).select("row_id", "model", "c")


@query("competence_regress", sql(["preds"], "SELECT row_id, model, c FROM comp", [("near", _NEAR), ("comp", _COMP_R)]))
def _(spark, sf):
    return blend.competences(blend.neighbours(_pool(spark, sf), FEATURES, 7, True), True).select("row_id", "model", "c")


@query("topn_members", sql(["preds"], "SELECT row_id, CAST(r AS INTEGER) AS pos, model, c FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, idx) AS r FROM comp) WHERE r <= 2", [("near", _NEAR), ("comp", _COMP)]))
def _(spark, sf):
    return blend.top_members(blend.competences(blend.neighbours(_pool(spark, sf), FEATURES, 7)), 2)


_BODY, _STEPS = _dew_sql(_COMP, [1, 2, 0], 0.5, [("near", _NEAR)])


@query("dew_classify", sql(["preds"], _BODY, _STEPS))
def _(spark, sf):
    out = blend.dew_classify(_pool(spark, sf), FEATURES, 7, [1, 2, None], 0.5)
    return rounded(out.select("row_id", "top_n", "blend"), ["blend"])


_BODY_R, _STEPS_R = _dew_sql(_COMP_R, [1, 2, 0], None, [("near", _NEAR)])


@query("dew_regress", sql(["preds"], _BODY_R, _STEPS_R))
def _(spark, sf):
    out = blend.dew_regress(_pool(spark, sf), FEATURES, 7, [1, 2, None])
    return rounded(out.select("row_id", "top_n", "blend"), ["blend"])


_GCOMP = """SELECT t.row_id, t.idx, t.model, t.p, g.c FROM preds t JOIN (SELECT idx, CASE WHEN m > 0.5 THEN round(m / (s + 0.01), 9) ELSE 0 END AS c FROM
    (SELECT idx, avg(1 - CASE WHEN y = 1 THEN 1 - p ELSE p END) AS m, stddev_pop(1 - CASE WHEN y = 1 THEN 1 - p ELSE p END) AS s FROM preds WHERE role = 'val' GROUP BY idx)) g USING (idx) WHERE t.role = 'test'"""
_BODY_G, _STEPS_G = _dew_sql(_GCOMP, [1, 0], 0.5, [])


@query("dew_global", sql(["preds"], _BODY_G, _STEPS_G))
def _(spark, sf):
    p = preds(spark, sf)
    comp = blend.global_competences(p.filter("role = 'val'").withColumn("e", blend.error_classify()))
    out = blend.dew_global(p.filter("role = 'test'").select("row_id", "idx", "model", "p"), comp, [1, None])
    return rounded(out.select("row_id", "top_n", "blend"), ["blend"])


@query("dew_weights", sql(["preds"], "SELECT row_id, idx, model, round(exp(c) / sum(exp(c)) OVER (PARTITION BY row_id), 6) AS w FROM comp", [("near", _NEAR), ("comp", _COMP)]))
def _(spark, sf):
    comp = blend.competences(blend.neighbours(_pool(spark, sf), FEATURES, 7))
    return rounded(blend.weights_all(comp), ["w"])


@query("reuse_predictions", sql(["preds"], _BODY, _STEPS))
def _(spark, sf):
    # predictions made once, stored, and read back by the blend
    path = scratch(spark, "predictions")
    preds(spark, sf).write.partitionBy("model").parquet(path)
    stored = spark.read.parquet(path)
    pool = []
    for name, *_ in SCORERS:
        mine = stored.filter(F.col("model") == name).withColumn("y", F.col("y").cast("double"))
        pool.append(blend.PoolMember(name, mine.filter("role = 'val'"), mine.filter("role = 'test'")))
    out = blend.dew_classify(pool, FEATURES, 7, [1, 2, None], 0.5)
    return rounded(out.select("row_id", "top_n", "blend"), ["blend"])


@query("blend_uniform", sql(["preds"], "SELECT row_id, round(avg(p), 6) AS blend FROM preds WHERE role = 'test' GROUP BY row_id"))
def _(spark, sf):
    return rounded(blend.blend_uniform(preds(spark, sf).filter("role = 'test'"), ["row_id"]), ["blend"])


# ---- lattice ---------------------------------------------------------------

_PAN = [Panel(x, [x]) for x in FEATURES]
_MASK = " + ".join(f"(CASE WHEN {x} IS NULL THEN 0 ELSE {1 << i} END)" for i, x in enumerate(FEATURES))
_ROWS = ("lr", f"SELECT row_id, y, CAST({_MASK} AS BIGINT) AS mask, a, n, s FROM cfm WHERE role = 'test'")
_FIT = ("lr", f"SELECT row_id, CAST({_MASK} AS BIGINT) AS mask FROM cfm WHERE role = 'train'")


def _fit_nodes(spark, sf):
    """Nodes of the fitted table with the rows that each can use: patterns are counted, then summed over supersets."""
    rows = incomplete(spark, sf).filter("role = 'train'").select(lattice.panel_mask(_PAN).alias("mask"))
    usable = lattice.superset_sums(rows.groupBy("mask").agg(F.count(F.lit(1)).alias("n_samples")), len(_PAN), ["n_samples"])
    return lattice.lattice_build(spark, _PAN, []).join(usable, "node_mask", "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


@query(
    "lattice_build",
    sql(["cfm"], "SELECT node AS node_mask, CAST(bit_count(node) AS INTEGER) AS level, (SELECT count(*) FROM lr WHERE lr.mask & node = node) AS n_samples FROM range(8) t(node)", [_FIT]),
)
def _(spark, sf):
    return _fit_nodes(spark, sf).select("node_mask", F.col("level").cast("int").alias("level"), "n_samples")


# a customer has a panel for each priority it ordered with; nodes are the patterns that occur and their intersections
@query(
    "lattice_closed",
    """WITH RECURSIVE cm AS (SELECT o_custkey, bit_or(1 << CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) // 2 AS mask FROM orders GROUP BY o_custkey),
    p AS (SELECT DISTINCT mask FROM cm), c AS (SELECT mask FROM p UNION SELECT 0 UNION SELECT c.mask & p.mask FROM c, p)
    SELECT CAST(mask AS BIGINT) AS node_mask, CAST(bit_count(mask) AS INTEGER) AS level, (SELECT count(*) FROM cm WHERE cm.mask & c.mask = c.mask) AS n_samples FROM c""",
)
def _(spark, sf):
    bit = F.pow(F.lit(2), F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("long")
    masks = table(spark, sf, "orders").groupBy("o_custkey").agg(F.bit_or(bit).alias("mask"))
    patterns = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n_samples"))
    found = lattice.closed_counts(lattice.closed_patterns(patterns), patterns)
    return found.select("node_mask", F.col("level").cast("int").alias("level"), "n_samples")


@query("lattice_edge_join", sql(["cfm"], "SELECT a.k AS parent, b.k AS child FROM nd a JOIN nd b ON a.k & b.k = a.k AND bit_count(b.k) = bit_count(a.k) + 1",
                                 [_FIT, ("nd", "SELECT DISTINCT k FROM lr, range(8) t(k) WHERE lr.mask & k = k")]))
def _(spark, sf):
    rows = incomplete(spark, sf).filter("role = 'train'").select(lattice.panel_mask(_PAN).alias("mask"))
    nodes = lattice.ancestors(rows, 3, "mask").select(F.col("ancestor").alias("node_mask")).distinct()
    return lattice.lattice_edges(nodes, 3)


@query("lattice_ancestor_join", sql(["cfm"], "SELECT DISTINCT mask, k AS ancestor FROM lr, range(8) t(k) WHERE mask & k = k AND k <> mask", [_ROWS]))
def _(spark, sf):
    rows = incomplete(spark, sf).filter("role = 'test'").select(lattice.panel_mask(_PAN).alias("mask"))
    return lattice.ancestors(rows, 3, "mask", proper=True)


# nodes with an odd number of panels exist; other patterns fall back to a subset
@query(
    "pattern_route_join",
    sql(["cfm"], "SELECT row_id, mask, max_by(k, CAST(bit_count(k) AS BIGINT) * 100 + k) AS node_mask FROM lr LEFT JOIN (SELECT k FROM range(8) t(k) WHERE bit_count(k) <> 2) ON mask & k = k GROUP BY row_id, mask", [_ROWS]),
)
def _(spark, sf):
    rows = incomplete(spark, sf).filter("role = 'test'").select("row_id", lattice.panel_mask(_PAN).alias("mask"))
    nodes = lattice.lattice_build(spark, _PAN, []).filter("level <> 2").select("node_mask")
    return lattice.route(rows, nodes, 3).select("row_id", "mask", "node_mask")


_NP = ("np", f"SELECT row_id, CAST(k AS BIGINT) AS node_mask, {sig('0.3 * k - 1 + ' + ' + '.join(f'(CASE WHEN k & {1 << i} > 0 THEN coalesce({x}, 0) ELSE 0 END)' for i, x in enumerate(FEATURES)))} AS p FROM lr, range(8) t(k) WHERE k & mask = k")


def _node_preds(spark, sf):
    """Fixed scorer per node on the features of the node."""
    rows = incomplete(spark, sf).filter("role = 'test'").withColumn("mask", observed_mask(FEATURES))
    nodes = rows.withColumn("node_mask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    nodes = nodes.filter(F.col("node_mask").bitwiseAND(F.col("mask")) == F.col("node_mask"))
    z = F.col("node_mask") * 0.3 - 1
    for i, x in enumerate(FEATURES):
        z = z + F.when(F.col("node_mask").bitwiseAND(F.lit(1 << i)) > 0, F.coalesce(F.col(x), F.lit(0.0))).otherwise(0.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return rows.select("row_id", "mask"), nodes.select("row_id", "node_mask", p.alias("p"))


@query("lattice_average", sql(["cfm"], "SELECT row_id, round(avg(p), 6) AS p, count(*) AS n_nodes FROM np GROUP BY row_id", [_ROWS, _NP]))
def _(spark, sf):
    rows, np_ = _node_preds(spark, sf)
    return rounded(lattice.lattice_average(rows, np_), ["p"])


@query("lattice_route_only", sql(["cfm"], "SELECT np.row_id, node_mask, round(p, 6) AS p FROM np JOIN lr USING (row_id) WHERE node_mask = mask", [_ROWS, _NP]))
def _(spark, sf):
    rows, np_ = _node_preds(spark, sf)
    return rounded(lattice.lattice_route_only(rows, np_), ["p"])


@query(
    "sink_lattice_json",
    sql(["cfm"], "SELECT CAST(k AS BIGINT) AS node_mask, CAST(bit_count(k) AS INTEGER) AS level, (SELECT count(*) FROM lr WHERE mask & k = k) AS n_samples FROM range(8) t(k)", [_FIT]),
)
def _(spark, sf):
    from gapweave.sources.writers import write_json

    path = scratch(spark, "lattice")
    write_json(_fit_nodes(spark, sf).drop("features"), path)
    back = spark.read.schema("node_mask long, level int, panels array<string>, n_samples long").json(path)
    return back.select("node_mask", "level", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


