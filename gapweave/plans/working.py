"""Working tables of the registered queries, built from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions.draw import draw
from gapweave.functions.scalar import half_even, linear, ratio, sigmoid
from gapweave.operators.clean import fit_minmax
from gapweave.operators.impute import Constants, MeanImputer
from gapweave.operators.inject import hide_mcar
from gapweave.plans.sqltext import FEATURES, RATES, SCORERS, SEED, TRIALS
from gapweave.session import cut, ensure_checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for round trips through files."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:8]}"


def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, a (balance), n (orders), s (their total), y (segment is BUILDING)."""
    o = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("row_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    )
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("a"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y")
    )
    return c.join(o, "row_id", "left").select(
        "row_id", "a", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"), "y"
    )


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    cf = cut(customer_features(spark, sf))  # the join runs once for the fits and the queries that follow
    d = draw("row_id", "role", SEED)
    role = F.when(d < 0.2, "test").when(d < 0.6, "val").otherwise("train")
    return fit_minmax(cf, FEATURES).transform(cf).select("row_id", "y", *FEATURES, role.alias("role"))


def incomplete(spark: SparkSession, sf: str) -> DataFrame:
    hidden = hide_mcar(FEATURES, "row_id", 0.3, SEED)
    df = scaled(spark, sf)
    return df.select("row_id", "y", "role", *[F.when(~hidden[x], F.col(x)).alias(x) for x in FEATURES])


def score(w: tuple, b: float) -> Column:
    return F.round(sigmoid(linear(dict(zip(FEATURES, w)), b)), 9)


def fills(means: Constants) -> dict[str, Constants]:
    return {
        "mean": means,
        "zero": Constants({x: 0.0 for x in FEATURES}),
        "half": Constants({x: 0.5 for x in FEATURES}),
    }


def pool_frames(spark: SparkSession, sf: str) -> list[tuple[int, str, DataFrame]]:
    """Per pipeline: filled features and prediction of every row.

    Each pipeline reads the table for both roles, so it is written once.
    """
    cfm = cut(incomplete(spark, sf))
    by = fills(MeanImputer(FEATURES).fit(cfm.filter("role = 'train'")))
    return [
        (i, name, by[kind].transform(cfm).withColumn("p", score(w, b)))
        for i, (name, kind, w, b) in enumerate(SCORERS)
    ]


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Long predictions of validation and test rows.

    The pool is unfolded inside the row (one struct per pipeline), so the
    source is read once however many pipelines there are.
    """
    cfm = incomplete(spark, sf)
    by = fills(MeanImputer(FEATURES).fit(cfm.filter("role = 'train'")))
    return _unfold(cfm.filter("role <> 'train'"), ["row_id", "role", "y"], lambda kind: by[kind].values)


def _unfold(df: DataFrame, keep: list[str], constants) -> DataFrame:
    entries = []
    for i, (name, kind, w, b) in enumerate(SCORERS):
        filled = {x: F.coalesce(F.col(x), _lit(constants(kind)[x])) for x in FEATURES}
        z = F.lit(b)
        for x, weight in zip(FEATURES, w):
            z = z + filled[x] * F.lit(weight)
        p = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 9)
        entries.append(
            F.struct(F.lit(i).alias("idx"), F.lit(name).alias("model"), *[filled[x].alias(f"_{x}") for x in FEATURES], p.alias("p"))
        )
    out = df.select(*keep, F.inline(F.array(*entries)))
    return out.select(*keep, "idx", "model", *[F.col(f"_{x}").alias(x) for x in FEATURES], "p")


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rate_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions at every null rate: rate, row_id, y, model, p."""
    base = scaled(spark, sf).withColumn("rate", F.explode(F.array(*[F.lit(r) for r in RATES])))
    swept = base.select(
        "rate", "row_id", "y", *[F.when(draw("row_id", f"cell:{x}", SEED) >= F.col("rate") / 100.0, F.col(x)).alias(x) for x in FEATURES]
    )
    rows = {r["rate"]: r for r in swept.groupBy("rate").agg(*[F.avg(x).alias(x) for x in FEATURES]).collect()}

    def constants(kind: str) -> dict:
        if kind != "mean":
            return {x: 0.0 if kind == "zero" else 0.5 for x in FEATURES}
        out = {}
        for x in FEATURES:
            c = None
            for r in RATES:
                hit = F.col("rate") == r
                c = F.when(hit, rows[r][x]) if c is None else c.when(hit, rows[r][x])
            out[x] = c
        return out

    return _unfold(swept, ["rate", "row_id", "y"], constants).select("rate", "row_id", "y", "model", "p")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Result table: rate, trial, model, metric, value (one aggregate, then unfolded)."""
    p = rate_preds(spark, sf).withColumn("trial", F.col("row_id") % TRIALS)
    guess, truth = half_even("p") == 1, F.col("y") == 1
    s = p.groupBy("rate", "trial", "model").agg(
        F.avg((half_even("p") == F.col("y")).cast("double")).alias("acc"),
        F.count_if(guess & truth).alias("tp"),
        F.count_if(guess & ~truth).alias("fp"),
        F.count_if(~guess & truth).alias("fn"),
    )
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    s = s.select("rate", "trial", "model", F.round("acc", 6).alias("accuracy"), F.round(f1, 6).alias("f1_score"))
    return s.unpivot(["rate", "trial", "model"], ["accuracy", "f1_score"], "metric", "value")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
