"""Queries: scans, sinks, projections, joins, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapweave.functions.draw import draw
from gapweave.operators import clean, reshape
from gapweave.operators.clean import Panel
from gapweave.operators.lattice import panels_missing
from gapweave.operators.ordered import ordinal
from gapweave.plans.registry import query
from gapweave.plans.sqltext import FEATURES, RATES, SEED, sql, u
from gapweave.plans.working import (
    incomplete,
    customer_features,
    rate_preds,
    results,
    scaled,
    scratch,
    table,
)
from gapweave.sources import readers, writers

CUSTOMER_DDL = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
RESULT_DDL = "trial long, model string, metric string, value double"

# ---- scans and sinks -------------------------------------------------------


@query(
    "scan_csv_nullmarker",
    sql(["cfm"], "SELECT row_id, round(a, 9) AS a, round(n, 9) AS n, round(s, 9) AS s, y FROM cfm"),
)
def _(spark, sf):
    path = scratch(spark, "nullmarker")
    df = incomplete(spark, sf).select("row_id", "a", "n", "s", "y")
    writers.write_csv(df, path, header=False, nullValue="?")
    back = readers.read_csv(spark, path, "row_id long, a double, n double, s double, y int", null_marker="?")
    return back.withColumns({x: F.round(x, 9) for x in FEATURES})


_MEASURED = readers.measure_columns()


@query(
    "scan_csv_generated_names",
    "SELECT s_suppkey AS id, round(s_acctbal, 2) AS mean_radius, CAST(s_nationkey AS DOUBLE) AS worst_fractaldimension FROM supplier",
)
def _(spark, sf):
    path = scratch(spark, "generated")
    s = table(spark, sf, "supplier")
    wide = s.select(
        "s_suppkey",
        *[(F.col("s_acctbal") if i < 29 else F.col("s_nationkey").cast("double")).alias(n) for i, n in enumerate(_MEASURED)],
    )
    writers.write_csv(wide, path, header=False)
    ddl = "id long, " + ", ".join(f"`{n}` double" for n in _MEASURED)
    back = readers.read_csv(spark, path, ddl)
    return back.select("id", F.round("mean_radius", 2).alias("mean_radius"), "worst_fractaldimension")


@query("scan_csv_header", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch(spark, "header")
    writers.write_csv(table(spark, sf, "customer").select(*[c.split(" ")[0] for c in CUSTOMER_DDL.split(", ")]), path)
    return readers.read_csv(spark, path, CUSTOMER_DDL, header=True)


@query("scan_csv_semicolon", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch(spark, "semicolon")
    writers.write_csv(
        table(spark, sf, "customer").select(*[c.split(" ")[0] for c in CUSTOMER_DDL.split(", ")]), path, sep=";"
    )
    return readers.read_csv(spark, path, CUSTOMER_DDL, header=True, sep=";")


@query(
    "scan_csv_keyed",
    "SELECT user_id AS subject, count(*) AS n_rows, round(sum(value), 4) AS total FROM events GROUP BY user_id",
)
def _(spark, sf):
    path = scratch(spark, "keyed")
    writers.write_csv(table(spark, sf, "events").select("user_id", "event_id", "value"), path, header=False)
    df = readers.read_csv(spark, path, "subject long, event_id long, value double")
    return df.groupBy("subject").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "scan_positional_names",
    """SELECT CAST(l_quantity AS DOUBLE) AS "0", l_discount AS "1", CAST(l_linenumber AS DOUBLE) AS "2",
    count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch(spark, "positional")
    writers.write_csv(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_linenumber"), path, header=False)
    df = readers.read_positional(spark, path, 3)
    return df.groupBy("0", "1", "2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_result_tree",
    sql(["results"], "SELECT 'rate=' || rate AS source, metric, model, count(*) AS n, round(avg(value), 6) AS value FROM results GROUP BY ALL"),
)
def _(spark, sf):
    path = scratch(spark, "tree")
    results(spark, sf).write.partitionBy("rate").option("header", True).csv(path)
    df = readers.read_tree(spark, path, "*.csv", RESULT_DDL, header=True)
    return df.groupBy("source", "metric", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("value")
    )


@query(
    "scan_many_union",
    """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return readers.union_all([c, s])


@query("sink_run_tables", sql(["results"], "SELECT rate, trial, model, metric, value FROM results"))
def _(spark, sf):
    paths = writers.write_run_tables({"metrics": results(spark, sf)}, scratch(spark, "run"), ["rate"])
    return spark.read.parquet(paths["metrics"]).select("rate", "trial", "model", "metric", "value")


@query("sink_params_json", sql(["results"], "SELECT DISTINCT rate, CAST(rate / 100.0 AS DOUBLE) AS p_miss, 'MCAR' AS mechanism FROM results"))
def _(spark, sf):
    path = scratch(spark, "params")
    grid = results(spark, sf).select("rate", (F.col("rate") / 100.0).cast("double").alias("p_miss"), F.lit("MCAR").alias("mechanism")).distinct()
    writers.write_json(grid, path)
    return spark.read.schema("rate int, p_miss double, mechanism string").json(path)


@query("sink_experiment_json", sql(["results"], "SELECT rate, model, count(*) * 2 AS n FROM results GROUP BY ALL"))
def _(spark, sf):
    path = scratch(spark, "experiment")
    df = results(spark, sf)
    writers.write_json(df, path)
    writers.write_json(spark.read.schema("rate int, " + RESULT_DDL).json(path), path + "-copy")
    writers.write_json(spark.read.schema("rate int, " + RESULT_DDL).json(path), path + "-copy", append=True)
    back = spark.read.schema("rate int, " + RESULT_DDL).json(path + "-copy")
    return back.groupBy("rate", "model").agg(F.count(F.lit(1)).alias("n"))


# ---- projections and filters -----------------------------------------------


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return Panel("price", ["o_orderkey", "o_totalprice"]).project(table(spark, sf, "orders"))


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").drop("o_orderdate")


@query("drop_columns_by_name_rule", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def _(spark, sf):
    return clean.drop_by_rule(table(spark, sf, "part"), lambda c: c.endswith("price"))


@query("rename_columns", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    by_map = clean.rename(s, {"s_suppkey": "id"})
    return clean.rename(by_map, ["id", "name", "nation", "balance"])


@query("filter_equals", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("filter_isin", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


_BAND = "CASE WHEN value < 0.6 THEN 'low' WHEN value < 0.7 THEN 'mid' ELSE 'high' END"


@query("filter_bands", sql(["results"], f"SELECT {_BAND} AS band, count(*) AS n, round(avg(value), 6) AS mean FROM results GROUP BY ALL"))
def _(spark, sf):
    r = results(spark, sf).withColumn("band", clean.band_of("value"))
    return r.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("dropna_any", sql(["cfm"], "SELECT row_id, role, round(a, 9) AS a, round(n, 9) AS n, round(s, 9) AS s, y FROM cfm WHERE a IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL"))
def _(spark, sf):
    return clean.complete_rows(incomplete(spark, sf)).withColumns({x: F.round(x, 9) for x in FEATURES})


@query("dropna_subset", sql(["cfm"], "SELECT row_id FROM cfm WHERE a IS NOT NULL AND s IS NOT NULL"))
def _(spark, sf):
    return clean.complete_rows(incomplete(spark, sf), ["a", "s"]).select("row_id")


@query("rows_with_any_panel", sql(["cfm"], "SELECT row_id FROM cfm WHERE coalesce(n, s) IS NOT NULL"))
def _(spark, sf):
    return clean.rows_with_any(incomplete(spark, sf), ["n", "s"], "row_id")


@query(
    "columns_without_nulls",
    sql(["cfm"], """SELECT f AS feature FROM (SELECT 'row_id' AS f, count(*) FILTER (row_id IS NULL) AS k FROM cfm
    UNION ALL SELECT 'y', count(*) FILTER (y IS NULL) FROM cfm UNION ALL SELECT 'role', count(*) FILTER (role IS NULL) FROM cfm
    UNION ALL SELECT 'a', count(*) FILTER (a IS NULL) FROM cfm UNION ALL SELECT 'n', count(*) FILTER (n IS NULL) FROM cfm
    UNION ALL SELECT 's', count(*) FILTER (s IS NULL) FROM cfm) t WHERE k = 0"""),
)
def _(spark, sf):
    return clean.null_counts(incomplete(spark, sf)).filter("nulls = 0").select("feature")


_PANELS = [Panel("money", ["a", "s"], "customer", 2.0), Panel("count", ["n"], "orders", 1.0)]


@query(
    "panel_catalog",
    sql(["cfm"], """SELECT 'money' AS panel, 'a' AS feature, 2.0::DOUBLE AS cost, count(a) AS present FROM cfm
    UNION ALL SELECT 'money', 's', 2.0, count(s) FROM cfm UNION ALL SELECT 'count', 'n', 1.0, count(n) FROM cfm"""),
)
def _(spark, sf):
    panels = clean.panel_table(spark, _PANELS)
    cells = incomplete(spark, sf).unpivot(["row_id"], FEATURES, "feature", "value")
    present = cells.groupBy("feature").agg(F.count("value").alias("present"))
    named = panels.select("panel", F.explode("features").alias("feature"), "cost")
    return present.join(F.broadcast(named), "feature").select("panel", "feature", "cost", "present")


@query("base_vs_panel_columns", sql(["cfm"], "SELECT row_id, round(n, 9) AS n FROM cfm"))
def _(spark, sf):
    df = incomplete(spark, sf).drop("role")
    base = clean.base_features(df, _PANELS[:1], "y", "row_id")
    return df.select("row_id", *[F.round(b, 9).alias(b) for b in base])


@query(
    "panels_from_names",
    "SELECT 'suppkey' AS panel, 's_suppkey' AS feature, count(s_suppkey) AS present FROM supplier UNION ALL "
    "SELECT 'name', 's_name', count(s_name) FROM supplier UNION ALL "
    "SELECT 'nationkey', 's_nationkey', count(s_nationkey) FROM supplier UNION ALL "
    "SELECT 'acctbal', 's_acctbal', count(s_acctbal) FROM supplier",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    panels = clean.panel_lookup(clean.panel_table(spark, clean.panels_from_names(s.columns)))
    n = clean.null_counts(s).select("feature", (F.col("n_rows") - F.col("nulls")).alias("present"))
    return n.join(F.broadcast(panels), "feature").select("panel", "feature", "present")


@query("select_by_dtype", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(*clean.numeric_columns(p))


@query("split_xy", sql(["cfm"], "SELECT row_id, round(a, 9) AS a, round(n, 9) AS n, round(s, 9) AS s, y FROM cfm WHERE role = 'val'"))
def _(spark, sf):
    from gapweave.operators.sampling import split_xy

    df = incomplete(spark, sf)
    folds = df.select("row_id", F.lit(0).alias("fold"), "role")
    return split_xy(df.drop("role"), folds, "row_id", 0, "val", [*FEATURES], "y").withColumns({x: F.round(x, 9) for x in FEATURES})


@query("binarise_target", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS y, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS signed FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", clean.binarise("o_orderstatus", "O").alias("y"), clean.binarise("o_orderstatus", "O", -1).alias("signed")
    )


_CODES = """SELECT p_type AS label, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)"""


@query("label_encode", f"SELECT p_partkey, CAST(c.code AS INTEGER) AS p_type FROM part JOIN ({_CODES}) c ON p_type = c.label")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return clean.label_codes(p, ["p_type"]).encode(p, "p_type")


@query("label_decode", "SELECT p_partkey, p_type AS label FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    codes = clean.label_codes(p, ["p_type"])
    return codes.decode(codes.encode(p, "p_type"), "p_type", "p_type").select("p_partkey", "label")


@query(
    "one_hot",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS h_f,
    CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS h_o,
    CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS h_p FROM orders""",
)
def _(spark, sf):
    hot = clean.one_hot("o_orderstatus", ["P", "O", "F"])
    return table(spark, sf, "orders").select("o_orderkey", hot.alias("h")).select(
        "o_orderkey", *[F.col("h")[i].alias(n) for i, n in enumerate(["h_f", "h_o", "h_p"])]
    )


_HIDE_SEG = u("c_custkey", "cell:seg") + " < 0.2"


@query(
    "remask",
    f"""SELECT c_custkey, CASE WHEN {_HIDE_SEG} THEN NULL ELSE
    (SELECT count(DISTINCT k.c_mktsegment) FROM customer k WHERE k.c_mktsegment < c.c_mktsegment) END AS code FROM customer c""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(draw("c_custkey", "cell:seg", SEED) >= 0.2, F.col("c_mktsegment")).alias("seg")
    )
    # the filler makes 'missing' a label of its own, sorted last; the mask takes it out again
    full = c.withColumn("code", F.coalesce("seg", F.lit("~missing")))
    coded = clean.label_codes(full, ["code"]).encode(full, "code")
    return clean.remask(coded, {"code": "seg"}, ["c_custkey", "code"]).withColumn("code", F.col("code").cast("long"))


@query("bracket_digit", "SELECT p_partkey, CAST(substr('[' || CAST(floor(p_size / 10) AS INTEGER) || '0-' || CAST(floor(p_size / 10) + 1 AS INTEGER) || '0)', 2, 1) AS INTEGER) AS digit FROM part")
def _(spark, sf):
    tens = F.floor(F.col("p_size") / 10)
    text = F.concat(F.lit("["), tens.cast("string"), F.lit("0-"), (tens + 1).cast("string"), F.lit("0)"))
    return table(spark, sf, "part").select("p_partkey", clean.bracket_digit(text).alias("digit"))


@query("fill_constant", sql(["cfm"], "SELECT row_id, round(coalesce(a, 0), 9) AS a, round(coalesce(n, 0), 9) AS n, round(coalesce(s, 0), 9) AS s FROM cfm"))
def _(spark, sf):
    df = incomplete(spark, sf).na.fill(0.0, FEATURES)
    return df.select("row_id", *[F.round(x, 9).alias(x) for x in FEATURES])


@query("minmax_scale", sql(["cfs"], "SELECT row_id, round(a, 9) AS a, round(n, 9) AS n, round(s, 9) AS s FROM cfs"))
def _(spark, sf):
    return scaled(spark, sf).select("row_id", *[F.round(x, 9).alias(x) for x in FEATURES])


@query("round_features", sql(["cfm"], "SELECT row_id, round_even(a, 8) AS a, round_even(n, 8) AS n, round_even(s, 8) AS s FROM cfm"))
def _(spark, sf):
    return clean.round_features(incomplete(spark, sf), FEATURES).select("row_id", *FEATURES)


@query("surrogate_id", "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    return clean.surrogate_ids(o, ["o_totalprice", "o_orderkey"], 1000).select("o_orderkey", "row_id")


@query(
    "surrogate_id_content",
    "SELECT o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY md5('+' || o_orderstatus || '|+' || o_orderpriority)) - 1 AS row_id FROM orders",
)
def _(spark, sf):
    return readers.with_row_id(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


_EXP_NAME = "'amount(0.' || (1 + l_suppkey % 9) || ')__features([' || array_to_string(list_transform(range(l_partkey % 9 + 1), lambda x: '''f' || x || ''''), ',') || '])'"


def _experiments(spark, sf):
    """One named experiment per (fraction, number of features), value = mean discount."""
    li = table(spark, sf, "lineitem")
    feats = F.concat_ws(",", F.transform(F.sequence(F.lit(0).cast("long"), F.col("l_partkey") % 9), lambda i: F.concat(F.lit("'f"), i.cast("string"), F.lit("'"))))
    name = F.concat(F.lit("amount(0."), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit(")__features(["), feats, F.lit("])"))
    return li.select(name.alias("name"), "l_discount", "l_tax").groupBy("name").agg(
        F.round(F.avg("l_discount"), 6).alias("d"), F.round(F.avg("l_tax"), 6).alias("t")
    )


_EXP = f"SELECT {_EXP_NAME} AS name, round(avg(l_discount), 6) AS d, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY 1"
_EXP_PARSED = """SELECT CAST(regexp_extract(name, 'amount\\(([0-9.]+)\\)', 1) AS DOUBLE) AS fraction,
    len(string_split(regexp_extract(name, 'features\\(\\[(.*)\\]\\)', 1), ',')) AS n_features, d, t FROM exps"""


@query("parse_experiment_name", sql([], _EXP_PARSED, [("exps", _EXP)]))
def _(spark, sf):
    return _experiments(spark, sf).select(
        clean.experiment_fraction("name").alias("fraction"), clean.experiment_feature_count("name").cast("long").alias("n_features"), "d", "t"
    )


@query(
    "performance_matrix",
    sql([], "SELECT CAST(trunc(fraction * 10 - 1) AS INTEGER) AS i, "
        + ", ".join(f"coalesce(max(d) FILTER (n_features = {j + 1}), 0) AS \"{j}\"" for j in range(9))
        + " FROM parsed GROUP BY 1", [("exps", _EXP), ("parsed", _EXP_PARSED)]),
)
def _(spark, sf):
    e = _experiments(spark, sf).select(
        clean.experiment_fraction("name").alias("fraction"), clean.experiment_feature_count("name").alias("n_features"), "d"
    )
    return reshape.performance_matrix(e, "fraction", "n_features", "d")


@query(
    "best_model_per_cell",
    sql([], "SELECT fraction, n_features, greatest(d, t) AS best_value, CASE WHEN d >= t THEN 0 ELSE 1 END AS best_idx FROM parsed",
        [("exps", _EXP), ("parsed", _EXP_PARSED)]),
)
def _(spark, sf):
    from gapweave.operators.metrics import best_per_cell

    e = _experiments(spark, sf).select(
        clean.experiment_fraction("name").alias("fraction"),
        clean.experiment_feature_count("name").cast("long").alias("n_features"),
        F.posexplode(F.array("d", "t")).alias("idx", "value"),
    )
    return best_per_cell(e, ["fraction", "n_features"])


@query("rate_from_metric_name", sql(["results"], "SELECT metric || '_' || rate AS name, rate AS parsed, count(*) AS n FROM results GROUP BY ALL"))
def _(spark, sf):
    r = results(spark, sf).select(F.concat_ws("_", "metric", F.col("rate").cast("string")).alias("name"))
    return r.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("parsed", clean.rate_of_metric("name"))


@query(
    "relabel_by_position",
    sql(["results"], """SELECT r.metric, r.rate, r.value, l.label FROM (SELECT metric, rate, round(avg(value), 6) AS value,
    row_number() OVER (ORDER BY metric, rate) AS pos FROM results GROUP BY metric, rate) r JOIN
    (SELECT m || '_' || rt AS label, row_number() OVER (ORDER BY m, rt) AS pos FROM
    (VALUES ('accuracy'), ('f1_score')) a(m), (VALUES (10), (30), (50)) b(rt)) l USING (pos)"""),
)
def _(spark, sf):
    means = results(spark, sf).groupBy("metric", "rate").agg(F.round(F.avg("value"), 6).alias("value"))
    placed = ordinal(means, ["metric", "rate"], "pos")
    names = [(i + 1, f"{m}_{r}") for i, (m, r) in enumerate((m, r) for m in ("accuracy", "f1_score") for r in RATES)]
    labels = spark.createDataFrame(names, "pos long, label string")
    return placed.join(F.broadcast(labels), "pos").select("metric", "rate", "value", "label")


@query(
    "model_display_order",
    sql(["results"], """SELECT model, CASE WHEN contains(model, 'knn') THEN 5 WHEN contains(model, 'mice') THEN 4
    WHEN contains(model, 'vanilla') THEN 3 WHEN contains(model, 'stacked') THEN 2 WHEN contains(model, 'inheritance') THEN 1 ELSE 0 END AS pos,
    round(avg(value), 6) AS mean FROM results GROUP BY model"""),
)
def _(spark, sf):
    r = results(spark, sf).groupBy("model").agg(F.round(F.avg("value"), 6).alias("mean"))
    return r.withColumn("pos", clean.display_order("model")).orderBy("pos", "model")


def _wide_results(spark, sf):
    r = results(spark, sf).withColumn("col", F.concat_ws("_", "metric", "model"))
    names = [f"{m}_{s}" for m in ("accuracy", "f1_score") for s in ("ds_mean", "stacked_zero", "vanilla_half")]
    return reshape.pivot_first(r, ["rate", "trial"], "col", "value", names)


@query(
    "select_metric_columns",
    sql(["results"], "SELECT rate, trial, " + ", ".join(f"max(value) FILTER (model = '{m}') AS accuracy_{m}" for m in ("ds_mean", "stacked_zero", "vanilla_half")) + " FROM results WHERE metric = 'accuracy' GROUP BY ALL"),
)
def _(spark, sf):
    w = _wide_results(spark, sf).withColumn("accuracy_oracle", F.lit(1.0))
    return w.select("rate", "trial", *clean.metric_columns(w.columns, "accuracy"))


# ---- joins -----------------------------------------------------------------


@query(
    "join_full_outer",
    """SELECT coalesce(x.k, y.k, z.k) AS k, x.a, y.n, z.m FROM
    (SELECT c_custkey AS k, c_acctbal AS a FROM customer) x
    FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) y ON x.k = y.k
    FULL JOIN (SELECT user_id AS k, count(*) AS m FROM events GROUP BY 1) z ON coalesce(x.k, y.k) = z.k""",
)
def _(spark, sf):
    x = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"))
    y = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    z = table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return x.join(y, "k", "full").join(z, "k", "full")


_KEYS = ["l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    "join_inner_multikey",
    f"SELECT a.l_orderkey, b.l_partkey FROM lineitem a JOIN lineitem b USING ({', '.join(_KEYS)}, l_shipdate)",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = [*_KEYS, "l_shipdate"]
    a = li.select("l_orderkey", *keys)
    b = li.select("l_partkey", *keys)
    return a.join(b, keys).select("l_orderkey", "l_partkey")


@query("join_anti_test", f"SELECT o_orderkey, o_totalprice FROM orders WHERE NOT {u('o_orderkey', 'test')} < 0.2")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    test = o.filter(draw("o_orderkey", "test", SEED) < 0.2).select("o_orderkey")
    return o.join(test, "o_orderkey", "left_anti")


@query("join_semi_ids", f"SELECT event_id FROM events WHERE {u('user_id', 'train')} < 0.5")
def _(spark, sf):
    e = table(spark, sf, "events")
    ids = e.select("user_id").distinct().filter(draw("user_id", "train", SEED) < 0.5)
    return e.join(ids, "user_id", "left_semi").select("event_id")


@query(
    "join_positional",
    sql(["preds"], """SELECT e.row_id, e.model, round(w.p / t.total, 6) AS w, round(abs(e.y - e.p), 9) AS e FROM preds e JOIN preds w USING (row_id, model)
    JOIN (SELECT row_id, sum(p) AS total FROM preds GROUP BY 1) t ON t.row_id = e.row_id"""),
)
def _(spark, sf):
    from gapweave.plans.working import preds

    p = preds(spark, sf)
    total = p.groupBy("row_id").agg(F.sum("p").alias("total"))
    weights = p.join(total, "row_id").select("row_id", "model", (F.col("p") / F.col("total")).alias("w"))
    errors = p.select("row_id", "model", F.abs(F.col("y") - F.col("p")).alias("e"))
    return weights.join(errors, ["row_id", "model"]).select("row_id", "model", F.round("w", 6).alias("w"), F.round("e", 9).alias("e"))


@query(
    "param_grid",
    sql([], """SELECT row_number() OVER (ORDER BY p, m, n_name) - 1 AS i, p AS p_miss, m AS mechanism, n_name AS dataset FROM
    (SELECT DISTINCT l_discount AS p FROM lineitem WHERE l_discount > 0) a, (VALUES ('MAR'), ('MCAR')) b(m), nation"""),
)
def _(spark, sf):
    rates = table(spark, sf, "lineitem").filter("l_discount > 0").select(F.col("l_discount").alias("p_miss")).distinct()
    mechanisms = F.explode(F.array(F.lit("MAR"), F.lit("MCAR"))).alias("mechanism")
    grid = rates.select("p_miss", mechanisms)
    # names are exploded per grid row: a grid is a product of a few parameter lists
    names = [r[0] for r in table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]
    grid = grid.withColumn("dataset", F.explode(F.array(*[F.lit(n) for n in names])))
    return clean.surrogate_ids(grid, ["p_miss", "mechanism", "dataset"], 0, "i").select("i", "p_miss", "mechanism", "dataset")


@query(
    "cross_models_imputers",
    sql(["preds"], "SELECT DISTINCT model || '+' || f AS member, model, f AS imputer FROM preds, (VALUES ('mean'), ('knn'), ('ridge')) t(f)"),
)
def _(spark, sf):
    from gapweave.plans.working import preds

    models = preds(spark, sf).select("model").distinct()
    pairs = models.withColumn("imputer", F.explode(F.array(F.lit("mean"), F.lit("knn"), F.lit("ridge"))))
    return pairs.select(F.concat_ws("+", "model", "imputer").alias("member"), "model", "imputer")


# ---- set operations --------------------------------------------------------


@query("union_runs", sql(["rate_preds"], "SELECT rate, row_id, model, p FROM rate_preds"))
def _(spark, sf):
    p = rate_preds(spark, sf).select("rate", "row_id", "model", "p")
    return readers.union_all([p.filter(F.col("rate") == r) for r in RATES])


@query("union_folds", sql(["preds"], "SELECT role, row_id, model, p FROM preds"))
def _(spark, sf):
    from gapweave.plans.working import preds

    p = preds(spark, sf).select("role", "row_id", "model", "p")
    return p.filter("role = 'val'").unionByName(p.filter("role = 'test'"))


@query("union_train_test", sql(["cfm"], "SELECT row_id, role, a IS NULL AS m_a, n IS NULL AS m_n, s IS NULL AS m_s FROM cfm WHERE role <> 'val'"))
def _(spark, sf):
    df = incomplete(spark, sf).select("row_id", "role", *[F.col(x).isNull().alias(f"m_{x}") for x in FEATURES])
    return df.filter("role = 'train'").unionByName(df.filter("role = 'test'"))


@query("distinct_ids", "SELECT DISTINCT user_id FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct()


# ---- reshaping -------------------------------------------------------------


@query("melt", sql(["cfm"], " UNION ALL ".join(f"SELECT row_id, '{x}' AS variable, round({x}, 9) AS value FROM cfm" for x in FEATURES)))
def _(spark, sf):
    return reshape.melt(incomplete(spark, sf), ["row_id"], FEATURES).withColumn("value", F.round("value", 9))


@query(
    "pivot_first",
    sql(["preds"], "SELECT row_id, " + ", ".join(f"max(p) FILTER (model = '{m}') AS {m}" for m in ("ds_mean", "stacked_zero", "vanilla_half")) + " FROM preds GROUP BY row_id"),
)
def _(spark, sf):
    from gapweave.plans.working import preds

    p = preds(spark, sf)
    return reshape.pivot_first(p, ["row_id"], "model", "p", ["ds_mean", "stacked_zero", "vanilla_half"])


@query(
    "transpose",
    sql(["results"], "SELECT model, " + ", ".join(f"round(avg(value) FILTER (rate = {r}), 6) AS \"{r}\"" for r in RATES) + " FROM results WHERE metric = 'accuracy' GROUP BY model"),
)
def _(spark, sf):
    names = ["ds_mean", "stacked_zero", "vanilla_half"]
    acc = results(spark, sf).filter("metric = 'accuracy'")
    wide = acc.groupBy("rate").pivot("model", names).agg(F.round(F.avg("value"), 6))
    return reshape.transpose(wide, "rate", names, RATES, "model")


@query("split_by_rate", sql(["results"], "SELECT trial, model, metric, value FROM results WHERE rate = 30"))
def _(spark, sf):
    path = scratch(spark, "by-rate")
    results(spark, sf).write.partitionBy("rate").parquet(path)
    return spark.read.parquet(path).filter("rate = 30").select("trial", "model", "metric", "value")


@query("split_by_metric", sql(["results"], "SELECT rate, trial, model, value FROM results WHERE metric = 'f1_score'"))
def _(spark, sf):
    return results(spark, sf).filter("metric = 'f1_score'").select("rate", "trial", "model", "value")


# ---- small scalar functions on rows ----------------------------------------


@query("n_panels_missing", sql(["cfm"], """SELECT row_id, (CASE WHEN a IS NULL OR s IS NULL THEN 1 ELSE 0 END + CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS n_missing,
    2 - (CASE WHEN a IS NULL OR s IS NULL THEN 1 ELSE 0 END + CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS level FROM cfm"""))
def _(spark, sf):
    lookup = {"a": "money", "s": "money", "n": "count"}
    df = incomplete(spark, sf).select("row_id", panels_missing(lookup).alias("n_missing"))
    return df.withColumn("level", 2 - F.col("n_missing"))


@query("table_shape", "SELECT 6 AS n_cols, count(*) AS n_rows FROM orders")
def _(spark, sf):
    from gapweave.operators.metrics import table_shape

    return table_shape(table(spark, sf, "orders"))


@query("value_counts", sql(["cfm"], "SELECT role, y, count(*) AS n FROM cfm GROUP BY ALL"))
def _(spark, sf):
    from gapweave.operators.metrics import class_counts

    return class_counts(incomplete(spark, sf), ["role", "y"])


@query("infer_task_type", sql(["cf"], "SELECT count(DISTINCT y) AS n_values, count(*) AS n_rows, CASE WHEN count(DISTINCT y) < sqrt(count(*)) THEN 'classification' ELSE 'regression' END AS task FROM cf"))
def _(spark, sf):
    from gapweave.operators.metrics import task_type

    return task_type(customer_features(spark, sf), "y")


@query("spec_generic", sql(["cf"], "SELECT row_id, CASE WHEN n = 0 THEN 0 ELSE 1 END AS n, s FROM cf"))
def _(spark, sf):
    from gapweave.sources.specs import generic

    return generic(customer_features(spark, sf), "customers", "n", ["a", "y"], "row_id").df
