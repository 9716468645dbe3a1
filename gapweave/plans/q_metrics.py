"""Queries: metrics, ranks, thresholds, diversity, significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapweave.functions import scalar
from gapweave.functions.draw import draw
from gapweave.operators import clean, diversity, impute, metrics, reshape, significance, threshold
from gapweave.operators.blend import error_classify
from gapweave.operators.impute import Constants, MeanImputer
from gapweave.operators.inject import Injected, hide_mcar
from gapweave.operators.ordered import kth_values
from gapweave.plans.registry import query
from gapweave.plans.sqltext import FEATURES, RATES, SCORERS, SEED, TRIALS, f1_of, sql, student_p, u
from gapweave.plans.working import incomplete, preds, results, scaled, table

MODELS = [s[0] for s in SCORERS]


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---- counts and one-pass statistics ----------------------------------------


@query(
    "null_counts",
    sql(["cfs", "cfm"], " UNION ALL ".join(
        f"SELECT '{x}' AS feature, (SELECT count(*) FILTER ({x} IS NULL) FROM cfs) AS before, (SELECT count(*) FILTER ({x} IS NULL) FROM cfm) AS after, (SELECT count(*) FROM cfm) AS n_rows"
        for x in FEATURES)),
)
def _(spark, sf):
    inj = Injected(scaled(spark, sf), FEATURES, hide_mcar(FEATURES, "row_id", 0.3, SEED), "row_id")
    before = clean.null_counts(inj.initial, FEATURES).select("feature", F.col("nulls").alias("before"))
    after = clean.null_counts(inj.incomplete, FEATURES).select("feature", F.col("nulls").alias("after"), "n_rows")
    return before.join(F.broadcast(after), "feature")


@query("null_check_after_impute", sql(["cfm", "mu"], " UNION ALL ".join(
    f"SELECT '{x}' AS feature, count(*) FILTER (coalesce(cfm.{x}, mu.{x}) IS NULL) > 0 AS any_null FROM cfm, mu" for x in FEATURES)))
def _(spark, sf):
    cfm = incomplete(spark, sf)
    filled = MeanImputer(FEATURES).fit(cfm.filter("role = 'train'")).transform(cfm)
    return clean.null_counts(filled, FEATURES).select("feature", (F.col("nulls") > 0).alias("any_null"))


@query("nan_mean", sql(["cfm"], "SELECT round(avg(a), 9) AS a, round(avg(n), 9) AS n, round(avg(s), 9) AS s FROM cfm"))
def _(spark, sf):
    # gaps arrive as NaN from numeric sources and become NULL before they are averaged
    df = incomplete(spark, sf).select(*[F.coalesce(F.col(x), F.lit(float("nan"))).alias(x) for x in FEATURES])
    return df.agg(*[F.round(F.avg(scalar.clean_nan(x)), 9).alias(x) for x in FEATURES])


_KQ = [0.1, 0.25, 0.5, 0.9]


@query(
    "kth_quantile",
    " UNION ALL ".join(
        f"SELECT {q}::DOUBLE AS q, (SELECT l_extendedprice FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) WHERE r = greatest(1, CAST(floor({q}::DOUBLE * (SELECT count(*) FROM lineitem)) AS BIGINT))) AS value"
        for q in _KQ),
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice")
    n = li.count()
    values = kth_values(li, {"l_extendedprice": [max(1, int(q * n)) for q in _KQ]})["l_extendedprice"]
    return spark.createDataFrame(list(zip(_KQ, values)), "q double, value double")


@query(
    "median_pair_distance",
    sql(["cfm"], """SELECT round(0.05 * max(h), 9) AS epsilon FROM (SELECT h, row_number() OVER (ORDER BY h) AS r, count(*) OVER () AS c FROM
    (SELECT ((l.a - k.a) * (l.a - k.a) + (l.n - k.n) * (l.n - k.n) + (l.s - k.s) * (l.s - k.s)) / 2 AS h FROM pick l, pick k) WHERE h > 0)
    WHERE r = greatest(1, CAST(floor(0.5 * c) AS BIGINT))""",
        [("m", "SELECT avg(a) AS a, avg(n) AS n, avg(s) AS s FROM cfm"),
         ("pick", f"SELECT coalesce(cfm.a, m.a) AS a, coalesce(cfm.n, m.n) AS n, coalesce(cfm.s, m.s) AS s FROM cfm, m ORDER BY {u('row_id', 'pairs')}, row_id LIMIT 2000")]),
)
def _(spark, sf):
    from gapweave.operators.distances import pair_scale

    return rounded(pair_scale(incomplete(spark, sf), FEATURES, "row_id", seed=SEED), ["epsilon"], 9)


@query(
    "corr_matrix",
    sql(["cfm"], " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM cfm" for a, b in [("a", "n"), ("a", "s"), ("n", "s")])),
)
def _(spark, sf):
    return rounded(metrics.correlation_matrix(incomplete(spark, sf), FEATURES), ["corr"])


_NORM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_MOMENTS = " UNION ALL ".join(
    f"""SELECT '{x}' AS feature, count(*)::DOUBLE AS n, avg(pow({x} - m, 3)) / pow(avg(pow({x} - m, 2)), 1.5) AS g1,
    avg(pow({x} - m, 4)) / pow(avg(pow({x} - m, 2)), 2) AS b2 FROM lineitem, (SELECT avg({x}) AS m FROM lineitem)""" for x in _NORM_COLS)


@query(
    "normality_test",
    sql([], """SELECT feature, round(zs * zs + zk * zk, 3) AS k2, round(exp(-(zs * zs + zk * zk) / 2), 6) AS p_value FROM z""", [
        ("mo", _MOMENTS),
        ("st", """SELECT *, g1 * sqrt((n+1)*(n+3)/(6.0*(n-2))) AS yy,
            sqrt(2*(3.0*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) - 1 AS w2,
            (b2 - 3.0*(n-1)/(n+1)) / sqrt(24.0*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS xx,
            6.0*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6.0*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS rb FROM mo"""),
        ("st2", "SELECT *, 6.0 + 8.0/rb*(2.0/rb + sqrt(1+4.0/(rb*rb))) AS aa, sqrt(2.0/(w2-1)) AS al FROM st"),
        ("z", """SELECT feature, 1/sqrt(ln(sqrt(w2))) * ln(yy/al + sqrt(yy/al*yy/al + 1)) AS zs,
            (1 - 2.0/(9*aa) - sign((1-2.0/aa)/(1+xx*sqrt(2.0/(aa-4)))) * pow(abs((1-2.0/aa)/(1+xx*sqrt(2.0/(aa-4)))), 1.0/3)) / sqrt(2.0/(9*aa)) AS zk FROM st2"""),
    ]),
)
def _(spark, sf):
    out = metrics.normality_test(table(spark, sf, "lineitem"), _NORM_COLS)
    return rounded(rounded(out, ["k2"], 3), ["p_value"])


# ---- classification metrics ------------------------------------------------

_LAB = "SELECT role, model, row_id, y, p, CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS label FROM preds"
_CONF = """SELECT role, model, count(*) FILTER (y <> 0 AND label = 1) AS tp, count(*) FILTER (y = 0 AND label = 0) AS tn,
    count(*) FILTER (y = 0 AND label <> 0) AS fp, count(*) FILTER (y <> 0 AND label <> 1) AS fn FROM lab GROUP BY ALL"""


def _labels(spark, sf):
    return preds(spark, sf).withColumn("label", scalar.threshold_label("p"))


@query("confusion_counts", sql(["preds"], "SELECT * FROM conf", [("lab", _LAB), ("conf", _CONF)]))
def _(spark, sf):
    return metrics.confusion_counts(_labels(spark, sf), ["role", "model"])


_RATES_SQL = """SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
    coalesce(tp / nullif(tp + fp, 0), 0) AS ppv, coalesce(tn / nullif(tn + fn, 0), 0) AS npv FROM conf"""


@query(
    "class_metrics",
    sql(["preds"], """SELECT role, model, tp, tn, fp, fn, round(sensitivity, 4) AS sensitivity, round(specificity, 4) AS specificity, round(ppv, 4) AS ppv,
    round(npv, 4) AS npv, round(sqrt(sensitivity * specificity), 4) AS gmean_sens_spec,
    round(pow(sensitivity * specificity * ppv * npv, 0.25), 4) AS gmean_all_metrics FROM rt""",
        [("lab", _LAB), ("conf", _CONF), ("rt", _RATES_SQL)]),
)
def _(spark, sf):
    return metrics.class_metrics(metrics.confusion_counts(_labels(spark, sf), ["role", "model"]))


@query("accuracy", sql(["preds"], "SELECT role, model, round(avg(CASE WHEN round_even(p, 0) = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds GROUP BY ALL"))
def _(spark, sf):
    return rounded(metrics.accuracy(preds(spark, sf), ["role", "model"]), ["accuracy"])


@query("f1_score", sql(["preds"], f"""SELECT role, model, round({f1_of('count(*) FILTER (round_even(p, 0) = 1 AND y = 1)', 'count(*) FILTER (round_even(p, 0) = 1 AND y <> 1)', 'count(*) FILTER (round_even(p, 0) <> 1 AND y = 1)')}, 6) AS f1_score FROM preds GROUP BY ALL"""))
def _(spark, sf):
    return rounded(metrics.f1_score(preds(spark, sf), ["role", "model"]), ["f1_score"])


_AUC = """SELECT {by}, round((sum(r) FILTER ({pos}) - count(*) FILTER ({pos}) * (count(*) FILTER ({pos}) + 1) / 2.0)
    / nullif(count(*) FILTER ({pos}) * count(*) FILTER (NOT ({pos})), 0), 6) AS roc_auc FROM
    (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0 AS r FROM {src}) GROUP BY {by}"""


@query("roc_auc", sql(["preds"], _AUC.format(by="role, model", pos="y = 1", p="p", src="preds")))
def _(spark, sf):
    return rounded(metrics.roc_auc(preds(spark, sf), ["role", "model"]), ["roc_auc"])


@query("roc_auc_orders", sql([], _AUC.format(by="o_orderpriority", pos="o_orderstatus = 'F'", p="o_totalprice", src="orders")))
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(metrics.roc_auc(o, ["o_orderpriority"], p="o_totalprice"), ["roc_auc"])


@query("mae_prediction", sql(["preds"], "SELECT role, model, round(avg(abs(p - y)), 6) AS mae FROM preds GROUP BY ALL"))
def _(spark, sf):
    return rounded(metrics.mean_abs_error(preds(spark, sf), ["role", "model"]), ["mae"])


_MASKED = " UNION ALL ".join(
    f"SELECT '{x}' AS feature, cfs.{x} AS truth, (SELECT avg({x}) FROM cfm WHERE role = 'train') AS filled FROM cfs JOIN cfm USING (row_id) WHERE cfm.{x} IS NULL" for x in FEATURES)


@query("masked_mae", sql(["cfs", "cfm"], "SELECT count(*) AS n_cells, round(avg(abs(filled - truth)), 6) AS mae FROM c", [("c", _MASKED)]))
def _(spark, sf):
    return rounded(_masked(spark, sf, []), ["mae"]).select("n_cells", "mae")


@query("masked_rmse", sql(["cfs", "cfm"], "SELECT count(*) AS n_cells, round(sqrt(avg((filled - truth) * (filled - truth))), 6) AS rmse FROM c", [("c", _MASKED)]))
def _(spark, sf):
    return rounded(_masked(spark, sf, []), ["rmse"]).select("n_cells", "rmse")


def _masked(spark, sf, by):
    inj = Injected(scaled(spark, sf), FEATURES, hide_mcar(FEATURES, "row_id", 0.3, SEED), "row_id")
    means = MeanImputer(FEATURES).fit(inj.incomplete.filter("role = 'train'")).values
    pairs = inj.cells.withColumn("filled", _by_feature(means))
    return metrics.masked_errors(pairs, by)


def _by_feature(values: dict):
    out = None
    for k, v in values.items():
        hit = F.col("feature") == k
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out


@query(
    "join_cells_original_imputed",
    sql(["cfs", "cfm"], " UNION ALL ".join(f"SELECT row_id, '{x}' AS feature, round(cfs.{x}, 9) AS truth, round(coalesce(cfm.{x}, 0.5), 9) AS filled, cfm.{x} IS NULL AS is_missing FROM cfs JOIN cfm USING (row_id)" for x in FEATURES)),
)
def _(spark, sf):
    inj = Injected(scaled(spark, sf), FEATURES, hide_mcar(FEATURES, "row_id", 0.3, SEED), "row_id")
    filled = Constants({x: 0.5 for x in FEATURES}).transform(inj.incomplete)
    long = metrics.cells(filled.select("row_id", *FEATURES), ["row_id"], FEATURES, "filled")
    return rounded(inj.cells.join(long, ["row_id", "feature"]), ["truth", "filled"], 9)


_IMPUTED = " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{x}' AS feature, cfs.{x} AS truth, {v} AS filled FROM cfs JOIN cfm USING (row_id) WHERE cfm.{x} IS NULL AND cfs.role <> 'val'"
    for x in FEATURES for m, v in [("ds_mean", f"(SELECT {x} FROM mu)"), ("stacked_zero", "0.0"), ("vanilla_half", "0.5")])


def _impute_eval(spark, sf):
    """Errors of every pipeline and feature, all from one pass over the rows."""
    inj = Injected(scaled(spark, sf), FEATURES, hide_mcar(FEATURES, "row_id", 0.3, SEED), "row_id")
    means = MeanImputer(FEATURES).fit(inj.incomplete.filter("role = 'train'")).values
    fills = {"ds_mean": means, "stacked_zero": dict.fromkeys(FEATURES, 0.0), "vanilla_half": dict.fromkeys(FEATURES, 0.5)}
    per_cell = F.array(*[F.struct(F.lit(m).alias("model"), _by_feature(v).alias("filled")) for m, v in fills.items()])
    cells = inj.__class__(inj.source.filter("role <> 'val'"), FEATURES, inj.hidden, "row_id").cells
    return metrics.masked_errors(cells.filter("is_missing").select("*", F.inline(per_cell)), ["model", "feature"])


@query("impute_rmse_by_feature", sql(["cfs", "cfm", "mu"], "SELECT model, feature, count(*) AS n_cells, round(sqrt(avg((filled - truth) * (filled - truth))), 6) AS rmse FROM c GROUP BY ALL", [("c", _IMPUTED)]))
def _(spark, sf):
    return rounded(_impute_eval(spark, sf), ["rmse"]).select("model", "feature", "n_cells", "rmse")


@query("impute_summary", sql(["cfs", "cfm", "mu"], "SELECT model, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae FROM (SELECT model, feature, sqrt(avg((filled - truth) * (filled - truth))) AS rmse, avg(abs(filled - truth)) AS mae FROM c GROUP BY ALL) GROUP BY model", [("c", _IMPUTED)]))
def _(spark, sf):
    e = _impute_eval(spark, sf)
    return e.groupBy("model").agg(F.round(F.avg("rmse"), 6).alias("rmse"), F.round(F.avg("mae"), 6).alias("mae"))


# a two-class column loses 30 % of its cells; its codes are imputed from the two other columns and scored where they were hidden
_CATEG = [
    ("c", f"""SELECT o_orderkey, CASE WHEN o_orderpriority >= '3' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS a,
    o_totalprice / 1e6::DOUBLE AS b, {u('o_orderkey', 'cell:prio')} < 0.3 AS h FROM orders"""),
    ("m", "SELECT avg(a) AS am, avg(b) AS bm, avg(t) AS tm, avg(a) FILTER (NOT h) AS ak, avg(b) FILTER (NOT h) AS bk, avg(t) FILTER (NOT h) AS tk FROM c"),
    ("s", "SELECT ak, bk, tk, sum((a - ak) * (a - ak)) + 1.0 AS aa, sum((b - bk) * (b - bk)) + 1.0 AS bb, sum((a - ak) * (b - bk)) AS ab, sum((a - ak) * (t - tk)) AS ta, sum((b - bk) * (t - tk)) AS tb FROM c, m WHERE NOT h GROUP BY ak, bk, tk"),
    ("c2", "SELECT 'priority' AS feature, t AS y, round(tk + (ta * bb - tb * ab) / (aa * bb - ab * ab) * (a - ak) + (tb * aa - ta * ab) / (aa * bb - ab * ab) * (b - bk), 9) AS p FROM c, s WHERE h"),
]


@query("impute_auc_by_feature", sql([], _AUC.format(by="feature", pos="y = 1", p="p", src="c2"), _CATEG))
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_totalprice").cast("double") / 1e6).alias("price"))
    codes = clean.label_codes(o, ["o_orderstatus"])
    o = codes.encode(o, "o_orderstatus").withColumn("truth", (F.col("o_orderpriority") >= "3").cast("double"))
    hidden = draw("o_orderkey", "cell:prio", SEED) < 0.3
    rows = o.select("o_orderkey", "truth", F.col("o_orderstatus").cast("double").alias("status"), "price", F.when(~hidden, F.col("truth")).alias("priority"), hidden.alias("gone"))
    ridge = impute.IterativeRidgeImputer(["status", "price", "priority"], rounds=1, bayes=False, strength=1.0)
    filled = ridge.fit(rows).transform(rows).filter("gone")
    cells = filled.select(F.lit("priority").alias("feature"), F.col("truth").cast("int").alias("y"), F.round("priority", 9).alias("p"))
    return rounded(metrics.roc_auc(cells, ["feature"]), ["roc_auc"])


@query("mse_column", sql(["cfs", "cfm"], "SELECT round(avg((truth - filled) * (truth - filled)), 9) AS mse FROM (SELECT cfs.s AS truth, coalesce(cfm.s, 0.5) AS filled FROM cfs JOIN cfm USING (row_id))"))
def _(spark, sf):
    inj = Injected(scaled(spark, sf), FEATURES, hide_mcar(FEATURES, "row_id", 0.3, SEED), "row_id").with_flags()
    d = F.col("s") - F.coalesce("x_s", F.lit(0.5))
    return inj.agg(F.round(F.avg(d * d), 9).alias("mse"))


@query("accuracy_column", f"SELECT round(avg(CASE WHEN o_orderstatus = CASE WHEN {u('o_orderkey', 'cell:st')} < 0.3 THEN 'O' ELSE o_orderstatus END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    filled = F.when(draw("o_orderkey", "cell:st", SEED) < 0.3, "O").otherwise(F.col("o_orderstatus"))
    return o.agg(F.round(F.avg((filled == F.col("o_orderstatus")).cast("double")), 6).alias("accuracy"))


# ---- result tables ---------------------------------------------------------


@query("metrics_mean_over_folds", sql(["results"], "SELECT rate, model, metric, round(avg(value), 6) AS mean FROM results GROUP BY ALL"))
def _(spark, sf):
    return results(spark, sf).groupBy("rate", "model", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("summary_stats", sql(["results"], "SELECT model, metric, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM results GROUP BY ALL"))
def _(spark, sf):
    return rounded(metrics.summary_stats(results(spark, sf), ["model", "metric"]), ["median", "mean", "sd"])


@query("mean_std_per_rate", sql(["results"], "SELECT rate, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM results GROUP BY ALL"))
def _(spark, sf):
    return rounded(metrics.mean_std(results(spark, sf), ["rate", "metric"]), ["mean", "sd"])


@query("mean_std_per_model", sql(["results"], "SELECT model, metric, rate, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM results GROUP BY ALL"))
def _(spark, sf):
    return rounded(metrics.mean_std(results(spark, sf), ["model", "metric", "rate"]), ["mean", "sd"])


@query(
    "box_stats",
    sql(["results"], """SELECT rate, model, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3,
    round(min(value) FILTER (value BETWEEN lo AND hi), 6) AS whisker_low, round(max(value) FILTER (value BETWEEN lo AND hi), 6) AS whisker_high,
    count(*) FILTER (NOT value BETWEEN lo AND hi) AS n_outliers FROM r JOIN b USING (rate, model) GROUP BY rate, model, q1, q2, q3""",
        [("r", "SELECT * FROM results WHERE metric = 'accuracy'"),
         ("q", "SELECT rate, model, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM r GROUP BY ALL"),
         ("b", "SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q")]),
)
def _(spark, sf):
    r = results(spark, sf).filter("metric = 'accuracy'")
    return rounded(metrics.box_stats(r, ["rate", "model"]), ["q1", "q2", "q3", "whisker_low", "whisker_high"])


_RANK = "SELECT rate, trial, metric, model, value, rank() OVER (PARTITION BY rate, trial, metric ORDER BY value DESC) + (count(*) OVER (PARTITION BY rate, trial, metric, value) - 1) / 2.0 AS rank FROM results"


@query("rank_models", sql(["results"], _RANK))
def _(spark, sf):
    return metrics.rank_models(results(spark, sf), ["rate", "trial", "metric"]).select("rate", "trial", "metric", "model", "value", "rank")


@query("rank_summary", sql(["results"], "SELECT model, metric, round(median(rank), 6) AS median, round(avg(rank), 6) AS mean, round(stddev_samp(rank), 6) AS sd FROM rk GROUP BY ALL", [("rk", _RANK)]))
def _(spark, sf):
    r = metrics.rank_models(results(spark, sf), ["rate", "trial", "metric"])
    return rounded(metrics.rank_summary(r, ["model", "metric"]), ["median", "mean", "sd"])


@query("error_order_per_row", sql(["preds"], "SELECT row_id, model, round(abs(p - y), 9) AS abs_error, row_number() OVER (PARTITION BY row_id ORDER BY abs(p - y) DESC, model) AS pos FROM preds"))
def _(spark, sf):
    return rounded(metrics.error_order(preds(spark, sf), ["row_id"]), ["abs_error"], 9).select("row_id", "model", "abs_error", "pos")


@query("head_n", sql(["results"], "SELECT rate, trial, model, metric, value FROM results WHERE value >= 0.6 ORDER BY value DESC, rate, trial, model, metric LIMIT 20"))
def _(spark, sf):
    from gapweave.operators.sampling import take_first

    high = results(spark, sf).filter("value >= 0.6").select("rate", "trial", "model", "metric", "value")
    return take_first(high, [F.desc("value"), "rate", "trial", "model", "metric"], 20)


@query(
    "kl_divergence",
    sql(["preds"], "SELECT role, round(sum(CASE WHEN a <> 0 THEN a * ln(a / b) ELSE 0 END), 6) AS kl FROM (SELECT role, row_id, max(p) FILTER (model = 'ds_mean') AS a, max(p) FILTER (model = 'vanilla_half') AS b FROM preds GROUP BY ALL) GROUP BY role"),
)
def _(spark, sf):
    wide = preds(spark, sf).groupBy("role", "row_id").agg(
        F.max(F.when(F.col("model") == "ds_mean", F.col("p"))).alias("a"),
        F.max(F.when(F.col("model") == "vanilla_half", F.col("p"))).alias("b"),
    )
    return rounded(metrics.kl_divergence(wide, ["role"], "a", "b"), ["kl"])


@query("weighted_error", sql(["preds"], "SELECT role, row_id, round(sum(p * abs(p - y)), 9) AS weighted_error FROM preds GROUP BY ALL"))
def _(spark, sf):
    p = preds(spark, sf).withColumns({"w": F.col("p"), "e": F.abs(F.col("p") - F.col("y"))})
    return rounded(metrics.weighted_error(p, ["role", "row_id"]), ["weighted_error"], 9)


@query("calibration_curve", sql(["preds"], "SELECT model, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 6) AS fraction_positive FROM preds GROUP BY ALL"))
def _(spark, sf):
    return rounded(metrics.calibration_curve(preds(spark, sf), ["model"]), ["mean_predicted", "fraction_positive"])


@query(
    "blend_vs_uniform",
    sql(["preds"], """SELECT run, round(share, 6) AS share, round(be, 6) AS blend_error, round(ue, 6) AS uniform_error,
    CASE WHEN share <> 0 THEN 'blend' ELSE 'uniform' END AS winner_any, CASE WHEN share > 0.5 THEN 'blend' ELSE 'uniform' END AS winner,
    round(be / ue, 6) AS error_ratio FROM (SELECT run, avg(CASE WHEN b < uu THEN 1.0 ELSE 0.0 END) AS share, avg(b) AS be, avg(uu) AS ue FROM e GROUP BY run)""",
        [("e", "SELECT row_id % 12 AS run, row_id, abs(sum(p * p) / sum(p) - max(y)) AS b, avg(abs(p - y)) AS uu FROM preds GROUP BY ALL")]),
)
def _(spark, sf):
    p = preds(spark, sf).withColumn("run", F.col("row_id") % 12)
    keep = ["run", "row_id", "model", "e"]
    members = p.withColumn("e", F.abs(F.col("p") - F.col("y"))).select(*keep)
    blend = p.groupBy("run", "row_id").agg((F.sum(F.col("p") * F.col("p")) / F.sum("p")).alias("b"), F.max("y").alias("y"))
    errors = blend.select("run", "row_id", F.lit("blend").alias("model"), F.abs(F.col("b") - F.col("y")).alias("e"))
    out = metrics.blend_vs_uniform(members.unionByName(errors))
    return rounded(out, ["share", "blend_error", "uniform_error", "error_ratio"])


# ---- scalar functions ------------------------------------------------------


@query("sigmoid", "SELECT c_custkey, round(1.0 / (1.0 + exp(-(c_acctbal / 1000.0 - 4))), 9) AS v FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(scalar.sigmoid(F.col("c_acctbal") / 1000.0 - 4), 9).alias("v"))


@query("softmax_group", sql(["preds"], "SELECT row_id, model, round(exp(p - m) / sum(exp(p - m)) OVER (PARTITION BY row_id), 9) AS w FROM (SELECT *, max(p) OVER (PARTITION BY row_id) AS m FROM preds)"))
def _(spark, sf):
    pool = preds(spark, sf).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "model", "p"))).alias("a"))
    w = scalar.softmax_array(F.transform("a", lambda s: s["p"]))
    pairs = F.zip_with("a", w, lambda s, v: F.struct(s["model"].alias("model"), v.alias("w")))
    return rounded(pool.select("row_id", F.inline(pairs)), ["w"], 9)


@query("clip", sql(["preds"], "SELECT row_id, model, greatest(0.0, least(1.0, y - p)) AS c1, greatest(0.0, least(1.0, (1 - y) - (1 - p))) AS c0 FROM preds"))
def _(spark, sf):
    p = preds(spark, sf)
    return p.select("row_id", "model", scalar.clip(F.col("y") - F.col("p"), 0.0, 1.0).alias("c1"),
                    scalar.clip((1 - F.col("y")) - (1 - F.col("p")), 0.0, 1.0).alias("c0"))


@query("abs_error", sql(["preds"], "SELECT row_id, model, abs(y - p) AS e FROM preds"))
def _(spark, sf):
    return preds(spark, sf).select("row_id", "model", F.abs(F.col("y") - F.col("p")).alias("e"))


@query("nan_to_zero", sql(["cfm"], "SELECT row_id, round(coalesce(a, 0), 9) AS a FROM cfm"))
def _(spark, sf):
    a = F.when(F.col("row_id") % 2 == 0, F.coalesce(F.col("a"), F.lit(float("nan")))).otherwise(F.col("a"))
    return incomplete(spark, sf).select("row_id", F.round(scalar.nan_to_zero(a), 9).alias("a"))


@query("dot_product", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 3) AS d FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    w = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i.cast("double"))
    return e.select("vec_id", F.round(scalar.dot(v, w), 3).alias("d"))


_EMB_MEAN = "SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i"


@query("euclidean", sql([], """SELECT e.vec_id, round(sqrt(sum((e.x - c.m) * (e.x - c.m))), 6) AS d FROM
    (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e JOIN c USING (i) GROUP BY e.vec_id""", [("c", _EMB_MEAN)]))
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = [r["m"] for r in means.orderBy("i").collect()]  # one number per dimension
    return e.select("vec_id", F.round(scalar.euclidean(F.col("v"), F.array(*[F.lit(m) for m in centre])), 6).alias("d"))


@query("nan_euclidean", sql(["cfm"], """SELECT row_id, round(sqrt(3.0 * (coalesce((a - 0.5) * (a - 0.5), 0) + coalesce((n - 0.25) * (n - 0.25), 0) + coalesce((s - 0.25) * (s - 0.25), 0))
    / nullif((CASE WHEN a IS NULL THEN 0 ELSE 1 END) + (CASE WHEN n IS NULL THEN 0 ELSE 1 END) + (CASE WHEN s IS NULL THEN 0 ELSE 1 END), 0)), 9) AS d FROM cfm"""))
def _(spark, sf):
    ref = F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))
    return incomplete(spark, sf).select("row_id", F.round(scalar.nan_euclidean(F.array(*FEATURES), ref), 9).alias("d"))


@query("threshold_label", sql(["preds"], "SELECT row_id, model, CASE WHEN p < 0.45 THEN 0 ELSE 1 END AS label FROM preds"))
def _(spark, sf):
    return preds(spark, sf).select("row_id", "model", scalar.threshold_label("p", 0.45).alias("label"))


@query("argmax_label", sql(["preds"], "SELECT row_id, (max({'p': p, 'i': -idx}))['i'] * -1 AS label FROM preds GROUP BY row_id"))
def _(spark, sf):
    from gapweave.operators.blend import argmax_label

    pool = preds(spark, sf).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "p"))).alias("a"))
    return pool.select("row_id", argmax_label(F.transform("a", lambda s: s["p"])).alias("label"))


@query("row_pattern", sql(["cfm"], "SELECT row_id, CAST((CASE WHEN a IS NULL THEN 0 ELSE 1 END) + (CASE WHEN n IS NULL THEN 0 ELSE 2 END) + (CASE WHEN s IS NULL THEN 0 ELSE 4 END) AS BIGINT) AS pattern FROM cfm"))
def _(spark, sf):
    return incomplete(spark, sf).select("row_id", scalar.observed_mask(FEATURES).alias("pattern"))


# ---- thresholds ------------------------------------------------------------


def _sweep_sql(n: int) -> list[tuple[str, str]]:
    return [
        ("cut", f"SELECT i FROM range(1, {n}) t(i)"),
        ("sw", f"""SELECT model, i, count(*) FILTER (y <> 0 AND p >= i / {float(n)}::DOUBLE) AS tp, count(*) FILTER (y = 0 AND p < i / {float(n)}::DOUBLE) AS tn,
            count(*) FILTER (y = 0 AND p >= i / {float(n)}::DOUBLE) AS fp, count(*) FILTER (y <> 0 AND p < i / {float(n)}::DOUBLE) AS fn FROM preds, cut GROUP BY ALL"""),
        ("sm", """SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS se, coalesce(tn / nullif(tn + fp, 0), 0) AS sp,
            coalesce(tp / nullif(tp + fp, 0), 0) AS pv, coalesce(tn / nullif(tn + fn, 0), 0) AS nv FROM sw"""),
        ("sg", f"SELECT *, sqrt(se * sp) AS g2, pow(se * sp * pv * nv, 0.25) AS g4, i / {float(n)}::DOUBLE AS cutoff FROM sm"),
    ]


@query(
    "threshold_sweep",
    sql(["preds"], "SELECT model, cutoff, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(g2, 6) AS gmean_sens_spec, round(g4, 6) AS gmean_all_metrics FROM sg", _sweep_sql(100)),
)
def _(spark, sf):
    s = threshold.threshold_sweep(preds(spark, sf), ["model"], step=1.0)
    s = s.select("model", "cutoff", "tp", "tn", "fp", "fn", "gmean_sens_spec", "gmean_all_metrics")
    return rounded(s, ["gmean_sens_spec", "gmean_all_metrics"])


@query(
    "best_threshold",
    sql(["preds"], "SELECT model, (min(i) - 1) / 1000.0::DOUBLE AS threshold, round(max(g), 6) AS gmean_all_metrics FROM (SELECT model, i, round(g4, 12) AS g, max(round(g4, 12)) OVER (PARTITION BY model) AS top FROM sg) WHERE g = top GROUP BY model", _sweep_sql(1000)),
)
def _(spark, sf):
    s = threshold.threshold_sweep(preds(spark, sf), ["model"], step=0.1)
    return rounded(threshold.best_threshold(s, ["model"], 0.1), ["gmean_all_metrics"])


@query(
    "threshold_curve_summary",
    sql(["preds"], "SELECT model, round(max(g2), 6) AS max_gmean_sens_spec, round(avg(g2), 6) AS mean_gmean_sens_spec, round(max(g4), 6) AS max_gmean_all_metrics, round(avg(g4), 6) AS mean_gmean_all_metrics FROM sg GROUP BY model", _sweep_sql(1000)),
)
def _(spark, sf):
    s = threshold.curve_summary(threshold.threshold_sweep(preds(spark, sf), ["model"], step=0.1), ["model"])
    return rounded(s, [c for c in s.columns if c != "model"])


# ---- diversity -------------------------------------------------------------

_PAIRS = """SELECT a.model AS m1, b.model AS m2,
    avg(CASE WHEN a.label = a.y AND b.label = b.y THEN 1.0 ELSE 0.0 END) AS n11, avg(CASE WHEN a.label = a.y AND b.label <> b.y THEN 1.0 ELSE 0.0 END) AS n10,
    avg(CASE WHEN a.label <> a.y AND b.label = b.y THEN 1.0 ELSE 0.0 END) AS n01, avg(CASE WHEN a.label <> a.y AND b.label <> b.y THEN 1.0 ELSE 0.0 END) AS n00
    FROM lab a JOIN lab b USING (row_id) WHERE a.model < b.model GROUP BY ALL"""
_DIV = [("lab", _LAB), ("pr", _PAIRS)]


def _outcomes(spark, sf):
    return diversity.pair_outcomes(_labels(spark, sf))


@query("pair_outcomes", sql(["preds"], "SELECT m1, m2, round(n11, 6) AS n11, round(n10, 6) AS n10, round(n01, 6) AS n01, round(n00, 6) AS n00 FROM pr", _DIV))
def _(spark, sf):
    return rounded(_outcomes(spark, sf), ["n11", "n10", "n01", "n00"])


_MEASURES = {
    "double_fault": (diversity.double_fault, "n00"),
    "negative_double_fault": (diversity.negative_double_fault, "-n00"),
    "q_statistic": (diversity.q_statistic, "(n11 * n00 - n01 * n10) / nullif(n11 * n00 + n01 * n10, 0)"),
    "ratio_errors": (diversity.ratio_errors, "coalesce((n01 + n10) / nullif(n00, 0), 1.7976931348623157e308)"),
    "disagreement": (diversity.disagreement, "n10 + n01"),
    "agreement": (diversity.agreement, "n00 + n11"),
    "diversity_corr": (diversity.correlation, "(n11 * n00 - n10 * n01) / nullif(sqrt((n11 + n01) * (n10 + n00) * (n11 + n10) * (n01 + n00)), 0)"),
}


def _register(name, measure, text):
    @query(name, sql(["preds"], f"SELECT m1, m2, round({text}, 6) AS value FROM pr", _DIV))
    def _(spark, sf):
        return rounded(diversity.pairwise(_outcomes(spark, sf), measure), ["value"])


for _name, (_measure, _text) in _MEASURES.items():
    _register(_name, _measure, _text)


@query("pool_diversity", sql(["preds"], "SELECT model, round(sum(v), 6) AS diversity FROM (SELECT m1 AS model, n10 + n01 AS v FROM pr UNION ALL SELECT m2, n10 + n01 FROM pr) GROUP BY model", _DIV))
def _(spark, sf):
    return rounded(diversity.pool_diversity(_outcomes(spark, sf), diversity.disagreement), ["diversity"])


# ---- significance ----------------------------------------------------------

_TT = """SELECT {by}, count(d) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0), 4) AS t, count(d) - 1 AS df FROM ({src}) GROUP BY ALL"""


@query(
    "ttest_paired",
    sql(["results"], _TT.format(by="model, metric, rate_a, rate_b", src="""SELECT a.model, a.metric, p.rate_a, p.rate_b, a.value - b.value AS d FROM (VALUES (10, 30), (30, 50), (10, 50)) p(rate_a, rate_b)
    JOIN results a ON a.rate = p.rate_a JOIN results b ON b.rate = p.rate_b AND a.trial = b.trial AND a.model = b.model AND a.metric = b.metric""")),
)
def _(spark, sf):
    t = significance.ttest_paired(results(spark, sf), ["model", "metric"], "rate", "trial", [(10, 30), (30, 50), (10, 50)])
    return rounded(rounded(t, ["mean_diff"]), ["t"], 4)


@query(
    "ttest_all_pairs",
    sql(["results"], _TT.format(by="model_a, model_b", src="""SELECT a.model AS model_a, b.model AS model_b, a.value - b.value AS d FROM results a JOIN results b USING (rate, trial, metric) WHERE a.model < b.model AND metric = 'accuracy'""")),
)
def _(spark, sf):
    r = results(spark, sf).filter("metric = 'accuracy'")
    t = significance.ttest_all_pairs(r, ["rate", "trial", "metric"])
    return rounded(rounded(t, ["mean_diff"]), ["t"], 4)


_IND = """SELECT model, metric, b.rate, round((a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 0), 4) AS t, a.n + b.n - 2 AS df
    FROM g a JOIN g b USING (model, metric) WHERE a.rate = 10 AND b.rate <> 10"""
_G = ("g", "SELECT model, metric, rate, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM results GROUP BY ALL")


@query("ttest_independent", sql(["results"], _IND, [_G]))
def _(spark, sf):
    return rounded(significance.ttest_independent(results(spark, sf), ["model", "metric"], "rate", 10), ["t"], 4)


_RAW_IND = _IND.replace("round(", "(").replace(", 4) AS t", ") AS t")


@query(
    "significance_flag",
    sql(["results"], f"""SELECT model, metric, rate, round(t, 6) AS t, df, round({student_p('t', 2 * TRIALS - 2)}, 6) AS p_value,
    CASE WHEN {student_p('t', 2 * TRIALS - 2)} < 0.05 THEN '*' ELSE 'NS' END AS flag FROM i""", [_G, ("i", _RAW_IND)]),
)
def _(spark, sf):
    t = significance.with_p(significance.ttest_independent(results(spark, sf), ["model", "metric"], "rate", 10))
    return rounded(t.withColumn("flag", significance.significance_flag(F.col("p_value"))), ["t", "p_value"], 6)


_PAIRED = """SELECT a.model, a.metric, p.rate_a, p.rate_b, avg(a.value - b.value) / nullif(stddev_samp(a.value - b.value) / sqrt(count(*)), 0) AS t
    FROM (VALUES (10, 30), (30, 50)) p(rate_a, rate_b) JOIN results a ON a.rate = p.rate_a JOIN results b ON b.rate = p.rate_b AND a.trial = b.trial
    AND a.model = b.model AND a.metric = b.metric GROUP BY ALL"""


@query(
    "means_and_pvalues",
    sql(["results"], f"""SELECT model, metric, 'mean_' || rate AS item, round(avg(value), 6) AS v FROM results GROUP BY ALL
    UNION ALL SELECT model, metric, 'p_' || rate_a || '_' || rate_b, round({student_p('t', TRIALS - 1)}, 6) FROM pt""", [("pt", _PAIRED)]),
)
def _(spark, sf):
    r = significance.means_and_pvalues(results(spark, sf), ["model", "metric"], "rate", "trial", RATES)
    return rounded(r, ["v"], 6)


@query(
    "sink_pvalues",
    sql(["results"], f"""SELECT model_a, model_b, n, round(m, 6) AS mean_diff, round(t, 4) AS t, n - 1 AS df, round({student_p('t', len(RATES) * TRIALS - 1)}, 6) AS p_value FROM
    (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, avg(a.value - b.value) AS m, avg(a.value - b.value) / nullif(stddev_samp(a.value - b.value) / sqrt(count(*)), 0) AS t
    FROM results a JOIN results b USING (rate, trial, metric) WHERE a.model < b.model AND metric = 'f1_score' GROUP BY ALL)"""),
)
def _(spark, sf):
    from gapweave.plans.working import scratch
    from gapweave.sources.writers import write_csv

    path = scratch(spark, "pvalues")
    t = significance.with_p(significance.ttest_all_pairs(results(spark, sf).filter("metric = 'f1_score'"), ["rate", "trial"]))
    write_csv(t, path)
    back = spark.read.schema(t.schema).option("header", True).csv(path)
    return rounded(rounded(back, ["mean_diff", "p_value"]), ["t"], 4)


_PAIR_P = f"""SELECT model_a, model_b, round({student_p('t', len(RATES) * TRIALS - 1)}, 6) AS p FROM
    (SELECT a.model AS model_a, b.model AS model_b, avg(a.value - b.value) / nullif(stddev_samp(a.value - b.value) / sqrt(count(*)), 0) AS t
    FROM results a JOIN results b USING (rate, trial, metric) WHERE a.model < b.model AND metric = 'accuracy' GROUP BY ALL)"""


# the p-value of a pair does not depend on its order, so both halves hold it
@query(
    "symmetric_p_matrix",
    sql(["results"], "SELECT m AS model_a, " + ", ".join(f"max(p) FILTER (o = '{m}') AS {m}" for m in sorted(MODELS)) + " FROM (SELECT model_a AS m, model_b AS o, p FROM tt UNION ALL SELECT model_b, model_a, p FROM tt) GROUP BY m",
        [("tt", _PAIR_P)]),
)
def _(spark, sf):
    r = results(spark, sf).filter("metric = 'accuracy'")
    pairs = rounded(significance.with_p(significance.ttest_all_pairs(r, ["rate", "trial", "metric"])), ["p_value"])
    return reshape.symmetric_matrix(pairs, "model_a", "model_b", "p_value", sorted(MODELS))


@query("sample_error_classify", sql(["preds"], "SELECT row_id, model, CASE WHEN y = 1 THEN 1 - p ELSE p END AS e FROM preds WHERE role = 'val'"))
def _(spark, sf):
    return preds(spark, sf).filter("role = 'val'").select("row_id", "model", F.round(error_classify(), 9).alias("e"))


@query("sample_error_regress", sql(["preds"], "SELECT row_id, model, abs(y - p) AS e FROM preds WHERE role = 'val'"))
def _(spark, sf):
    from gapweave.operators.blend import error_regress

    return preds(spark, sf).filter("role = 'val'").select("row_id", "model", error_regress().alias("e"))
