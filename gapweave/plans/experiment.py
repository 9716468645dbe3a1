"""Experiment runner: inject, split, fit a pool, blend, measure, write."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import blend, metrics, models
from gapweave.operators.clean import fit_minmax, label_codes, numeric_columns, round_features
from gapweave.operators.impute import MeanImputer
from gapweave.operators.inject import inject
from gapweave.operators.sampling import fold_roles, stratified_folds
from gapweave.session import cut
from gapweave.sources.specs import TableSpec
from gapweave.sources.writers import write_json, write_run_tables

# fixed values: neighbours, sizes of the weighted pools (0 = all), competence threshold, folds
NEIGHBOURS, TOP_N, COMPETENCE, FOLDS = 7, [1, 3, 0], 0.5, 5
TRAIN_FRACTION = 0.5


@dataclass
class Settings:
    k: int = NEIGHBOURS
    top_n: list[int] = field(default_factory=lambda: list(TOP_N))
    threshold: float = COMPETENCE
    folds: int = FOLDS
    train_fraction: float = TRAIN_FRACTION
    seed: int = 42
    parallel: int = 2
    stack_trees: int = 60
    fit_scaling_on: str = "all"  # 'train' avoids that test rows set the limits
    knn: dict = field(default_factory=dict)


@dataclass
class Outcome:
    """Long result tables of one parameter set."""

    metrics: DataFrame
    imputation: DataFrame
    predictions: DataFrame
    weights: DataFrame
    neighbours: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "metrics": self.metrics,
            "imputation_eval": self.imputation,
            "predictions": self.predictions,
            "weights": self.weights,
            "neighbours": self.neighbours,
        }


PoolFactory = Callable[[list[str], str, str], dict[str, models.ImputedModel]]


def run_one(
    spec: TableSpec, params: dict, make_pool: PoolFactory, settings: Settings | None = None, regression: bool = False,
    folds: DataFrame | None = None, only_folds: Iterable[int] | None = None,
) -> Outcome:
    """All folds of one parameter set. ``folds`` (fold, id, role) replaces the default split."""
    st = settings or Settings()
    feats = spec.features
    df = spec.df.select(spec.id_col, spec.target, *feats)
    numbers = numeric_columns(df)
    classes = [f for f in feats if f not in numbers]  # text becomes codes by sorted label
    if classes:
        codes = label_codes(df, classes)
        for f in classes:
            df = codes.encode(df, f)
        df = cut(df.select(spec.id_col, spec.target, *[F.col(f).cast("double").alias(f) if f in classes else F.col(f) for f in feats]))
    if st.fit_scaling_on == "all":
        df = fit_minmax(df, feats).transform(df)
    inj = inject(
        df, feats, spec.id_col, params["p_miss"], params.get("mechanism", "MCAR"), params.get("opt"),
        params.get("p_obs"), params.get("q"), st.seed,
    )
    table = cut(inj.with_flags())  # written once: every fold, imputer and measure reads it
    if folds is None:
        own = stratified_folds(table, spec.id_col, spec.target, st.folds, st.seed)
        folds = fold_roles(own, spec.id_col, st.folds, st.train_fraction, st.seed)
    folds = cut(folds)
    wanted = list(only_folds) if only_folds is not None else [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    outs = [_run_fold(spec, table, feats, classes, folds, f, make_pool, st, regression) for f in wanted]
    merged = {k: reduce(DataFrame.unionByName, [o[k] for o in outs]) for k in outs[0]}
    return Outcome(**merged)


def _run_fold(spec, table, feats, classes, folds, fold, make_pool, st, regression) -> dict[str, DataFrame]:
    mine = folds.filter(F.col("fold") == fold).select(spec.id_col, "role")
    rows = table.join(mine, spec.id_col)
    incomplete = rows.select(spec.id_col, spec.target, "role", *[F.col(f"x_{x}").alias(x) for x in feats])
    part = {r: cut(incomplete.filter(F.col("role") == r).drop("role")) for r in ("train", "val", "test")}
    scale = None
    if st.fit_scaling_on == "train":
        scale = fit_minmax(part["train"], feats)
        part = {r: scale.transform(p) for r, p in part.items()}
    part["train"] = cut(round_features(part["train"], feats))
    pool = models.fit_pool(make_pool(feats, spec.target, spec.id_col), part["train"], st.parallel)
    views = models.pool_views(pool, part["val"], part["test"])
    names = [v.name for v in views]
    if spec.id_col != "row_id":
        views = [blend.PoolMember(v.name, v.val.withColumnRenamed(spec.id_col, "row_id"), v.test.withColumnRenamed(spec.id_col, "row_id")) for v in views]
    val, test = models.long_predictions(views, "val"), models.long_predictions(views, "test")
    near = cut(blend.neighbours(views, feats, st.k, regression, **st.knn))
    comp = blend.competences(near, regression)
    dew = cut(blend.dew(comp, st.top_n, None if regression else st.threshold))
    stack = (models.stack_regressor if regression else models.stack_classifier)(names, trees=st.stack_trees).fit(val)
    y = views[0].test.select("row_id", "y")
    blended = [
        blend.blend_uniform(test, ["row_id"]).select("row_id", F.lit("uniform").alias("model"), F.col("blend").alias("p")),
        stack.predict(test).select("row_id", F.lit("stacking").alias("model"), F.col("blend").alias("p")),
        dew.select("row_id", F.concat(F.lit("dew_top_"), F.when(F.col("top_n") == 0, "all").otherwise(F.col("top_n").cast("string"))).alias("model"), F.col("blend").alias("p")),
    ]
    every = reduce(DataFrame.unionByName, blended).join(y, "row_id")
    preds = cut(test.select("row_id", "model", "p", "y").unionByName(every.select("row_id", "model", "p", "y")))
    tag = F.lit(fold).alias("fold")
    return {
        "metrics": _measure(preds, regression).select(tag, "model", "metric", "value"),
        "imputation": _imputation_errors(spec, rows, part, pool, feats, classes, scale).select(tag, "model", "feature", "n_cells", "mae", "rmse", "roc_auc"),
        "predictions": preds.select(tag, "row_id", "model", "y", "p"),
        "weights": blend.weight_rows(dew).select(tag, "row_id", "top_n", "model", "w"),
        "neighbours": near.select(tag, "row_id", "model", "rank", "val_id", "dist"),
    }


def _measure(preds: DataFrame, regression: bool) -> DataFrame:
    if regression:
        m = metrics.mean_abs_error(preds, ["model"])
        return m.select("model", F.lit("mae").alias("metric"), F.col("mae").alias("value"))
    wide = (
        metrics.roc_auc(preds, ["model"])
        .join(metrics.accuracy(preds, ["model"]), "model")
        .join(metrics.f1_score(preds, ["model"]), "model")
    )
    return wide.unpivot(["model"], ["roc_auc", "accuracy", "f1_score"], "metric", "value")


def _imputation_errors(spec, rows, part, pool, feats, classes, scale) -> DataFrame:
    """Error of each member (and of mean filling, once) on the injected cells of train and test rows.

    Where the rows were scaled by limits of the training rows, the truth is scaled by the same limits. Text columns of
    two labels also have the AUC of their imputed codes; null for others.
    """
    seen = part["train"].unionByName(part["test"])
    truth = rows.filter(F.col("role") != "val").select(
        spec.id_col, *[(scale.column(x) if scale else F.col(x)).alias(f"t_{x}") for x in feats], *[F.col(f"m_{x}") for x in feats]
    )
    fillers = {name: m.imputed(seen) for name, m in pool.items()}
    fillers["mean"] = MeanImputer(feats).fit(part["train"]).transform(seen)
    parts = []
    for name, filled in fillers.items():
        both = filled.select(spec.id_col, *[F.col(x).alias(f"f_{x}") for x in feats]).join(truth, spec.id_col)
        e = metrics.masked_errors_wide(
            both, feats, {x: f"t_{x}" for x in feats}, {x: f"f_{x}" for x in feats}, {x: F.col(f"m_{x}") for x in feats}
        )
        auc = None
        for x in classes:
            cells = both.filter(F.col(f"m_{x}") & F.col(f"t_{x}").isNotNull() & F.col(f"f_{x}").isNotNull())
            two = cells.agg(F.min(f"t_{x}").alias("lo"), F.max(f"t_{x}").alias("hi"), F.count_distinct(f"t_{x}").alias("n")).first()
            if two["n"] == 2:
                scored = cells.select(F.lit(x).alias("feature"), (F.col(f"t_{x}") == two["hi"]).cast("int").alias("y"), F.col(f"f_{x}").alias("p"))
                one = metrics.roc_auc(scored, ["feature"]).select("feature", "roc_auc")
                auc = one if auc is None else auc.unionByName(one)
        e = e.join(auc, "feature", "left") if auc is not None else e.withColumn("roc_auc", F.lit(None).cast("double"))
        parts.append(e.withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def run_grid(
    spec: TableSpec, grid: list[dict], make_pool: PoolFactory, out: str, settings: Settings | None = None,
    regression: bool = False, **options,
) -> dict[str, str]:
    """Every parameter set in turn; results go to one folder per table, partitioned by the parameters."""
    spark = spec.df.sparkSession
    lookup = []
    for i, params in enumerate(grid):
        result = run_one(spec, params, make_pool, settings, regression, **options)
        tagged = {
            name: t.withColumns(
                {"i": F.lit(i), "mechanism": F.lit(params.get("mechanism", "MCAR")), "p_miss": F.lit(float(params["p_miss"]))}
            )
            for name, t in result.tables().items()
        }
        write_run_tables(tagged, f"{out}/run={i}", ["mechanism", "p_miss"])
        lookup.append((i, float(params["p_miss"]), params.get("mechanism", "MCAR"), params.get("opt"), params.get("p_obs"), params.get("q")))
    schema = "i int, p_miss double, mechanism string, opt string, p_obs double, q double"
    write_json(spark.createDataFrame(lookup, schema), f"{out}/params_lookup")
    every = spark.read.option("basePath", out).parquet(*[f"{out}/run={i}/metrics" for i in range(len(grid))])
    final = every.groupBy("mechanism", "p_miss", "model", "metric").agg(F.avg("value").alias("value"))
    evals = spark.read.option("basePath", out).parquet(*[f"{out}/run={i}/imputation_eval" for i in range(len(grid))])
    summary = evals.groupBy("mechanism", "p_miss", "model").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("roc_auc").alias("roc_auc"))
    return write_run_tables({"final_results": final, "imputation_eval_results": summary}, out, csv=True)
