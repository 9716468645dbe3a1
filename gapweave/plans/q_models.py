"""Queries on trained models (rows-only check; invariants are tested) and on streams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F


from gapweave.operators import gaptrees, impute, models
from gapweave.operators.clean import Panel
from gapweave.operators.inject import hide_mcar
from gapweave.operators.lattice import Lattice
from gapweave.plans.experiment import Settings, run_one
from gapweave.plans.registry import query
from gapweave.plans.sqltext import FEATURES, SEED, sig, sql, u
from gapweave.plans.working import customer_features, incomplete, preds, scaled, scratch, table
from gapweave.session import cut
from gapweave.sources.specs import generic
from gapweave.streaming.apply import read_files, run_available

TREES = 50  # trees per forest, as in the study


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _parts(spark, sf):
    df = cut(incomplete(spark, sf).withColumn("y", F.col("y").cast("double")))
    return {r: df.filter(F.col("role") == r).drop("role") for r in ("train", "val", "test")}


def _forest():
    return RandomForestClassifier(maxDepth=4, numTrees=TREES, seed=0)


@query("impute_then_classify")
def _(spark, sf):
    p = _parts(spark, sf)
    m = models.ImputedModel(impute.MeanImputer(FEATURES), _forest, FEATURES, "y").fit(p["train"])
    m.tune_threshold(p["val"], step=1.0)
    return rounded(m.labels(p["test"]).select("row_id", "y", "p", "label"), ["p"])


def _regression_rows(spark, sf):
    """Gaps in a and n; the target s is whole, as a target has no injected gaps."""
    hidden = hide_mcar(FEATURES, "row_id", 0.3, SEED)
    df = scaled(spark, sf)
    return cut(df.select("row_id", "role", *[F.when(~hidden[x], F.col(x)).alias(x) for x in ("a", "n")], "s"))


@query("impute_then_regress")
def _(spark, sf):
    rows = _regression_rows(spark, sf)
    make = lambda: RandomForestRegressor(maxDepth=4, numTrees=TREES, seed=0)
    m = models.ImputedModel(impute.IterativeRidgeImputer(["a", "n"]), make, ["a", "n"], "s").fit(rows.filter("role = 'train'"))
    return rounded(m.predict(rows.filter("role = 'test'")).select("row_id", F.col("s").alias("y"), "p"), ["y", "p"])


@query("impute_iter_gbt")
def _(spark, sf):
    p = _parts(spark, sf)
    model = impute.IterativeTreesImputer(FEATURES, depth=4, trees=50, rounds=10).fit(p["train"])
    return rounded(model.transform(p["test"]).select("row_id", *FEATURES), FEATURES)


@query("impute_iter_rf")
def _(spark, sf):
    p = _parts(spark, sf)
    model = impute.IterativeTreesImputer(FEATURES, depth=4, trees=TREES, rounds=10, forest=True).fit(p["train"])
    return rounded(model.transform(p["test"]).select("row_id", *FEATURES), FEATURES)


def _small_pool(features, target, id_col):
    imputers = {
        "mean": lambda: impute.MeanImputer(features),
        "iter_ridge": lambda: impute.IterativeRidgeImputer(features),
        "knn": lambda: impute.KnnImputer(features, id_col),
    }
    return models.cross({"forest": _forest}, imputers, features, target, id_col)


@query("pool_classify")
def _(spark, sf):
    p = _parts(spark, sf)
    pool = models.fit_pool(_small_pool(FEATURES, "y", "row_id"), p["train"])
    views = models.pool_views(pool, p["val"], p["test"])
    return rounded(models.long_predictions(views, "test").select("row_id", "model", "y", "p"), ["p"])


@query("pool_regress")
def _(spark, sf):
    df = _regression_rows(spark, sf)
    feats = ["a", "n"]
    imputers = {"mean": lambda: impute.MeanImputer(feats), "iter_ridge": lambda: impute.IterativeRidgeImputer(feats)}
    makers = {"forest": lambda: RandomForestRegressor(maxDepth=4, numTrees=TREES, seed=0)}
    pool = models.fit_pool(models.cross(makers, imputers, feats, "s", "row_id"), df.filter("role = 'train'"))
    views = models.pool_views(pool, df.filter("role = 'val'"), df.filter("role = 'test'"))
    return rounded(models.long_predictions(views, "test").select("row_id", "model", "y", "p"), ["y", "p"])


@query("stack")
def _(spark, sf):
    p = preds(spark, sf).withColumn("y", F.col("y").cast("double"))
    names = [r[0] for r in p.select("model", "idx").distinct().orderBy("idx").collect()]
    stack = models.stack_classifier(names).fit(p.filter("role = 'val'"))
    return rounded(stack.predict(p.filter("role = 'test'")), ["blend"])


def _platt_sql(steps: int = 10) -> list[tuple[str, str]]:
    """Chained Newton steps for slope and intercept, smoothed targets."""
    out = [
        ("pn", "SELECT count(*) FILTER (y = 1) AS np, count(*) FILTER (y <> 1) AS nn FROM preds WHERE role = 'val'"),
        ("pv", "SELECT p AS f, CASE WHEN y = 1 THEN (np + 1.0::DOUBLE) / (np + 2.0::DOUBLE) ELSE 1.0::DOUBLE / (nn + 2.0::DOUBLE) END AS t FROM preds, pn WHERE role = 'val'"),
        ("k0", "SELECT 0.0::DOUBLE AS w, ln((np + 1.0::DOUBLE) / (nn + 1.0::DOUBLE)) AS b FROM pn"),
    ]
    for i in range(steps):
        out.append((f"g{i}", f"SELECT w, b, sum((q - t) * f) AS gw, sum(q - t) AS gb, sum(q * (1 - q) * f * f) AS hww, sum(q * (1 - q) * f) AS hwb, sum(q * (1 - q)) AS hbb FROM (SELECT *, {sig('w * f + b')} AS q FROM pv, k{i}) GROUP BY w, b"))
        out.append((f"k{i + 1}", f"SELECT w - (gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb) AS w, b - (gb * hww - gw * hwb) / (hww * hbb - hwb * hwb) AS b FROM g{i}"))
    return out


@query("platt_calibration", sql(["preds"], f"SELECT row_id, model, y, p, round({sig('w * p + b')}, 6) AS calibrated FROM preds, k10 WHERE role = 'test'", _platt_sql()))
def _(spark, sf):
    p = preds(spark, sf)
    fitted = models.Platt().fit(p.filter("role = 'val'"))
    return rounded(fitted.predict(p.filter("role = 'test'").select("row_id", "model", "y", "p")), ["calibrated"])


_EACH = [Panel(x, [x]) for x in FEATURES]


def _masked_lattice(spark, sf, settings):
    """A node for each set of the three features, every one fitted on all rows."""
    p = _parts(spark, sf)
    return Lattice(_EACH, [], "y").fit_masked(p["train"], settings), p


@query("lattice_fit_masked")
def _(spark, sf):
    lat, p = _masked_lattice(spark, sf, gaptrees.Settings(rounds=50, depth=4))
    return rounded(lat.average(p["test"]), ["p"])


def _masked_sql(bins: int) -> str:
    """Best first split of every node by brute force: each column, edge and side for the gaps."""
    cells = " UNION ALL ".join(f"SELECT {i} AS f, {x} AS x, p - y AS g, p * (1 - p) AS h FROM tr, sh" for i, x in enumerate(FEATURES))
    extra = [
        ("tr", "SELECT y, a, n, s FROM cfm WHERE role = 'train'"),
        ("sh", "SELECT avg(y) AS p, count(*) AS rows FROM tr"),
        ("ce", cells),
        ("wh", "SELECT f, count(*) AS n, sum(g) AS g, sum(h) AS h, min(x) AS lo, max(x) AS hi FROM ce GROUP BY f"),
        ("ca", f"""SELECT ce.f, s, side, wh.n, wh.g, wh.h, lo + (hi - lo) * ((s + 1) / {bins}.0::DOUBLE) AS edge, count(*) AS nl, sum(ce.g) AS gl, sum(ce.h) AS hl
            FROM ce JOIN wh ON wh.f = ce.f, range({bins}) t(s), range(2) u(side)
            WHERE CASE WHEN x IS NULL THEN side = 0 ELSE s = {bins - 1} OR x <= lo + (hi - lo) * ((s + 1) / {bins}.0::DOUBLE) END GROUP BY ALL"""),
        ("ga", "SELECT f, s, side, edge, nl, round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 9) AS gain FROM ca WHERE nl > 0 AND nl < n"),
        ("be", "SELECT k, ga.* FROM range(8) t(k) JOIN ga ON (k >> f) & 1 = 1 WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, s, side) = 1"),
    ]
    body = f"""SELECT CAST(t.k AS BIGINT) AS node_mask, rows AS n_samples, CAST(coalesce(f, -1) AS BIGINT) AS feature, CASE WHEN s < {bins - 1} THEN round(edge, 9) END AS edge,
        side = 0 AS gap_left, CAST(coalesce(nl, rows) AS BIGINT) AS n_left, round(coalesce(gain, 0), 6) AS gain FROM range(8) t(k) CROSS JOIN sh LEFT JOIN be ON be.k = t.k"""
    return sql(["cfm"], body, extra)


@query("lattice_masked_nodes", _masked_sql(16))
def _(spark, sf):
    lat, _ = _masked_lattice(spark, sf, gaptrees.Settings(rounds=1, depth=1, bins=16))
    rows = []
    for view, node in enumerate(lat.nodes):
        gain, column, at, left, a, _ = lat.masked.gains[0][view, 0]
        edge = float(lat.masked.edges[column][at]) if column >= 0 and at < 15 else None
        rows.append((node, lat.counts[node], column, edge, bool(left) if column >= 0 else None, int(a[0]), gain))
    schema = "node_mask long, n_samples long, feature long, edge double, gap_left boolean, n_left long, gain double"
    return rounded(rounded(spark.createDataFrame(rows, schema), ["edge"], 9), ["gain"])

def _det(m: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL expressions."""
    if not m:
        return "1.0"
    parts = [f"{'-' if k % 2 else ''}({m[0][k]}) * ({_det([r[:k] + r[k + 1:] for r in m[1:]])})" for k in range(len(m))]
    return " + ".join(f"({p})" for p in parts)


def _ridge_nodes_sql() -> list[tuple[str, str]]:
    """lw: weights of every node's ridge regression of y (strength 1) on the training rows complete for it; lp: scores."""
    out, weights = [("tr", "SELECT * FROM cfm WHERE role = 'train'")], []
    for k in range(1, 8):
        xs = [x for i, x in enumerate(FEATURES) if k >> i & 1]
        rows = f"FROM tr WHERE {' AND '.join(f'{x} IS NOT NULL' for x in xs)}"
        out.append((f"m{k}", f"SELECT count(*) AS c, avg(y) AS ym, {', '.join(f'avg({x}) AS m_{x}' for x in xs)} {rows}"))
        cells = [f"sum(({x} - m_{x}) * ({z} - m_{z})) + {1.0 if x == z else 0.0} AS s_{x}{z}" for x in xs for z in xs]
        right = [f"sum(({x} - m_{x}) * (y - ym)) AS r_{x}" for x in xs]
        out.append((f"s{k}", f"SELECT c, ym, {', '.join(f'm_{x}' for x in xs)}, {', '.join(cells + right)} {rows.replace('FROM tr', f'FROM tr, m{k}')} GROUP BY ALL"))
        matrix = [[f"s_{x}{z}" for z in xs] for x in xs]
        solved = {x: f"({_det([[f'r_{xs[i]}' if j == at else matrix[i][j] for j in range(len(xs))] for i in range(len(xs))])}) / ({_det(matrix)})" for at, x in enumerate(xs)}
        out.append((f"w{k}", f"SELECT c, ym, {', '.join(f'm_{x}' for x in xs)}, {', '.join(f'{e} AS w_{x}' for x, e in solved.items())} FROM s{k}"))
        intercept = "ym - (" + " + ".join(f"w_{x} * m_{x}" for x in xs) + ")"
        weights.append(f"SELECT {k} AS k, c, {intercept} AS b, {', '.join(f'w_{x}' if x in xs else f'NULL::DOUBLE AS w_{x}' for x in FEATURES)} FROM w{k}")
    out.append(("lw", "SELECT 0 AS k, (SELECT count(*) FROM tr) AS c, 0.5::DOUBLE AS b, " + ", ".join(f"NULL::DOUBLE AS w_{x}" for x in FEATURES) + " UNION ALL " + " UNION ALL ".join(weights)))
    total = " + ".join(f"coalesce(w_{x}, 0) * coalesce({{c}}{x}, 0)" for x in FEATURES)
    has = " AND ".join(f"(w_{x} IS NULL OR {{c}}{x} IS NOT NULL)" for x in FEATURES)
    score = f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, b + {total})), 9)"
    out.append(("lp", f"SELECT row_id, role, y, k, {score.format(c='cfm.')} AS p FROM cfm, lw WHERE {has.format(c='cfm.')}"))
    return out


def _node_cuts_sql() -> list[tuple[str, str]]:
    """lt: best cut-off of every node among hundredths on the validation rows, one step below the one evaluated."""
    sides = {"tp": "y <> 0 AND p >= i / 100.0::DOUBLE", "tn": "y = 0 AND p < i / 100.0::DOUBLE", "fp": "y = 0 AND p >= i / 100.0::DOUBLE", "fn": "y <> 0 AND p < i / 100.0::DOUBLE"}
    return [
        *_ridge_nodes_sql(),
        ("lc", f"SELECT k, i, {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in sides.items())} FROM lp, range(1, 100) t(i) WHERE role = 'val' GROUP BY ALL"),
        ("lg", "SELECT k, i, round(pow(coalesce(tp / nullif(tp + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0) * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tn / nullif(tn + fn, 0), 0), 0.25), 12) AS g FROM lc"),
        ("lt", "SELECT k, (min(i) - 1) / 100.0::DOUBLE AS threshold, round(max(g), 6) AS gmean_all_metrics FROM (SELECT *, max(g) OVER (PARTITION BY k) AS top FROM lg) WHERE g = top GROUP BY k"),
    ]


def _ridge_lattice(spark, sf):
    p = _parts(spark, sf)
    return Lattice(_EACH, [], "y").fit_linear(p["train"]), p


@query(
    "lattice_fit_complete",
    sql(["cfm"], "SELECT CAST(lw.k AS BIGINT) AS node_mask, CAST(bit_count(lw.k) AS INTEGER) AS level, c AS n_samples, threshold, round(b, 6) AS intercept, "
        + ", ".join(f"round(w_{x}, 6) AS w_{x}" for x in FEATURES) + " FROM lw JOIN lt ON lt.k = lw.k", _node_cuts_sql()),
)
def _(spark, sf):
    lat, p = _ridge_lattice(spark, sf)
    lat.fit_thresholds(p["val"])
    fitted = [(n, b, *(w.get(x) for x in FEATURES)) for n, (w, b) in lat.linear.items()]
    weights = spark.createDataFrame(fitted, "node_mask long, intercept double, " + ", ".join(f"w_{x} double" for x in FEATURES))
    facts = lat.node_table(spark).select("node_mask", "level", "n_samples", "threshold")
    return rounded(facts.join(weights, "node_mask"), ["intercept", *(f"w_{x}" for x in FEATURES)])


@query("lattice_thresholds", sql(["cfm"], "SELECT CAST(k AS BIGINT) AS node_mask, threshold, gmean_all_metrics FROM lt", _node_cuts_sql()))
def _(spark, sf):
    lat, p = _ridge_lattice(spark, sf)
    return rounded(lat.fit_thresholds(p["val"]), ["threshold", "gmean_all_metrics"])


@query("lattice_average_ridge", sql(["cfm"], "SELECT row_id, round(avg(p), 6) AS p, count(*) AS n_nodes FROM lp WHERE role = 'test' GROUP BY row_id", _ridge_nodes_sql()))
def _(spark, sf):
    lat, p = _ridge_lattice(spark, sf)
    return rounded(lat.average(p["test"]), ["p"])


# every row is filled, so every row takes the full node and all its ancestors
@query(
    "lattice_average_imputed",
    sql(["cfm"], "SELECT row_id, round(avg(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, b + " + " + ".join(f"coalesce(w_{x}, 0) * coalesce(cfm.{x}, mu.{x})" for x in FEATURES)
        + ")), 9)), 6) AS p, count(*) AS n_nodes FROM cfm, lw, mu WHERE role = 'test' GROUP BY row_id", [("mu", "SELECT " + ", ".join(f"avg({x}) AS {x}" for x in FEATURES) + " FROM cfm WHERE role = 'train'"), *_ridge_nodes_sql()]),
)
def _(spark, sf):
    lat, p = _ridge_lattice(spark, sf)
    filler = impute.MeanImputer(FEATURES).fit(p["train"])
    return rounded(lat.average_imputed(p["test"], filler), ["p"])


def _logistic():
    return LogisticRegression(regParam=0.01)


@query("lattice_stack")
def _(spark, sf):
    lat, p = _ridge_lattice(spark, sf)
    return rounded(lat.stack(p["train"], p["test"], _logistic), ["p"])


@query("constant_classifier", sql(["cf"], "SELECT row_id, 0.5::DOUBLE AS p FROM cf"))
def _(spark, sf):
    return models.constant_classifier(customer_features(spark, sf).select("row_id"))


def _signed(spark, sf):
    df = incomplete(spark, sf).withColumn("y", F.when(F.col("y") == 1, 1).otherwise(-1))
    return cut(df)


@query("boost_missing_aware")
def _(spark, sf):
    df = _signed(spark, sf)
    boost = models.StumpBoost(FEATURES, "y", rounds=3).fit(df.filter("role <> 'test'"))
    return rounded(boost.predict(df.filter("role = 'test'")), ["score"])


@query(
    "boost_weight_update",
    sql(["cfs"], """SELECT row_id, round(w * exp(-al * yy * h) / sum(w * exp(-al * yy * h)) OVER (), 12) AS w FROM
    (SELECT row_id, yy, h, 1.0 / count(*) OVER () AS w, 0.5 * ln((1 - avg(CASE WHEN yy <> h THEN 1.0 ELSE 0.0 END) OVER ()) / avg(CASE WHEN yy <> h THEN 1.0 ELSE 0.0 END) OVER ()) AS al
    FROM (SELECT row_id, CASE WHEN y = 1 THEN 1 ELSE -1 END AS yy, CASE WHEN a > 0.8 THEN 1 ELSE -1 END AS h FROM cfs))"""),
)
def _(spark, sf):
    import math

    df = scaled(spark, sf).select(
        "row_id", F.when(F.col("y") == 1, 1).otherwise(-1).alias("_y"), F.when(F.col("a") > 0.8, 1).otherwise(-1).alias("_h")
    )
    s = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_y") != F.col("_h")).cast("double")).alias("e")).first()
    alpha = 0.5 * math.log((1 - s["e"]) / s["e"])
    moved = models.reweigh(df.withColumn("_w", F.lit(1.0 / s["n"])), alpha)
    total = moved.agg(F.sum("_w")).first()[0]
    return moved.select("row_id", F.round(F.col("_w") / total, 12).alias("w"))


def _adaboost_sql(rounds: int, bins: int) -> str:
    """Round by round: the stump of least Gini impurity over all columns and edges, its error, the new weights."""
    value = {x: f"coalesce({x}, 0.0)" for x in FEATURES}
    cells = " UNION ALL ".join(f"SELECT {i} AS f, row_id, {v} AS x FROM cfm" for i, v in enumerate(value.values()))
    out = [
        ("ce", cells),
        ("tr", "SELECT row_id, CASE WHEN y = 1 THEN 1 ELSE -1 END AS y FROM cfm WHERE role <> 'test'"),
        ("li", "SELECT f, min(x) AS lo, max(x) AS hi FROM ce JOIN tr USING (row_id) GROUP BY f"),
        ("ed", f"SELECT f, s, lo + (hi - lo) * ((s + 1) / {bins}.0::DOUBLE) AS e FROM li, range({bins - 1}) t(s)"),
        ("sd", "SELECT ed.f, s, e, row_id, y, x <= e AS l FROM ed JOIN ce ON ce.f = ed.f JOIN tr USING (row_id)"),
        ("w0", "SELECT row_id, y, 1.0::DOUBLE / count(*) OVER () AS w FROM tr"),
    ]
    for k in range(rounds):
        out += [
            (f"g{k}", f"SELECT f, s, e, coalesce(sum(w) FILTER (l AND sd.y = 1), 0) AS lp, coalesce(sum(w) FILTER (l AND sd.y = -1), 0) AS ln, coalesce(sum(w) FILTER (NOT l AND sd.y = 1), 0) AS rp, coalesce(sum(w) FILTER (NOT l AND sd.y = -1), 0) AS rn FROM sd JOIN w{k} USING (row_id) GROUP BY ALL"),
            (f"b{k}", f"SELECT *, CASE WHEN lp > ln THEN 1 ELSE -1 END AS vl, CASE WHEN rp > rn THEN 1 ELSE -1 END AS vr FROM g{k} WHERE lp + ln > 0 AND rp + rn > 0 ORDER BY round(2 * lp * ln / (lp + ln) + 2 * rp * rn / (rp + rn), 12), f, s LIMIT 1"),
            (f"a{k}", f"SELECT *, 0.5 * ln((1 - er) / er) AS alpha FROM (SELECT f, e, vl, vr, (CASE WHEN vl = 1 THEN ln ELSE lp END + CASE WHEN vr = 1 THEN rn ELSE rp END) / (lp + ln + rp + rn) AS er FROM b{k})"),
            (f"w{k + 1}", f"SELECT row_id, y, w / sum(w) OVER () AS w FROM (SELECT w{k}.row_id, w{k}.y, w * exp(-alpha * w{k}.y * CASE WHEN x <= e THEN vl ELSE vr END) AS w FROM w{k}, a{k} JOIN ce ON ce.f = a{k}.f WHERE ce.row_id = w{k}.row_id)"),
        ]
    votes = " UNION ALL ".join(f"SELECT row_id, alpha * CASE WHEN x <= e THEN vl ELSE vr END AS v FROM ce JOIN a{k} ON a{k}.f = ce.f" for k in range(rounds))
    body = f"SELECT row_id, round(sum(v), 6) AS score, CAST(sign(round(sum(v), 9)) AS INTEGER) AS label FROM ({votes}) JOIN cfm USING (row_id) WHERE role = 'test' GROUP BY row_id"
    return sql(["cfm"], body, out)


@query("adaboost_rounds", _adaboost_sql(20, 16))
def _(spark, sf):
    df = _signed(spark, sf)
    boost = models.StumpBoost(FEATURES, "y", 20, shift_bias=False, gap_aware=False, bins=16, by_rank=False).fit(df.filter("role <> 'test'"))
    out = boost.predict(df.filter("role = 'test'"))
    return rounded(out.withColumn("label", F.signum(F.round("score", 9)).cast("int")), ["score"])


@query("adaboost_baseline")
def _(spark, sf):
    df = _signed(spark, sf)
    boost = models.adaboost(FEATURES, "y", rounds=100).fit(df.filter("role <> 'test'"))
    out = boost.predict(df.filter("role = 'test'")).join(df.select("row_id", "y"), "row_id")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("y")).cast("double")), 6).alias("accuracy"))


@query("experiment_run")
def _(spark, sf):
    spec = generic(customer_features(spark, sf), "customers", "y", id_col="row_id")
    out = run_one(spec, {"p_miss": 0.1, "mechanism": "MCAR"}, _small_pool, Settings())  # folds, trees and pools of the study
    return rounded(out.metrics, ["value"])


# ---- streams ---------------------------------------------------------------


@query(
    "stream_score",
    f"""SELECT event_id, CASE WHEN {u('event_id', 'cell:value')} < 0.2 THEN 1 ELSE 0 END AS was_hidden,
    round({sig("CASE WHEN " + u('event_id', 'cell:value') + " < 0.2 THEN (SELECT avg(value) FROM events WHERE NOT (" + u('event_id', 'cell:value') + " < 0.2)) ELSE value END / 100.0")}, 6) AS p FROM events""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    hidden = hide_mcar(["value"], "event_id", 0.2, SEED)
    filler = impute.MeanImputer(["value"]).fit(events.filter(~hidden["value"]))  # what was hidden is not known to it
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    steps = [
        lambda d: d.select("event_id", hidden["value"].cast("int").alias("was_hidden"), F.when(~hidden["value"], F.col("value")).alias("value")),
        filler.transform,
        lambda d: d.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("value") / 100.0))),
    ]
    run_available(read_files(spark, sf, events, "events.parquet"), steps, out, state)
    return spark.read.parquet(out).select("event_id", "was_hidden", F.round("p", 6).alias("p"))


