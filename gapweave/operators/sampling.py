"""Resampling and splits. All are exact-size and reproducible from keyed draws."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapweave.functions.draw import draw
from gapweave.operators.ordered import lowest, rank_by_draw
from gapweave.session import cut

SplitFn = Callable[[DataFrame], DataFrame]


def undersample(df: DataFrame, y: str, id_col: str, seed: int = 0) -> DataFrame:
    """Cut every class to the size of the smallest; a filter, no row moves."""
    sizes = _class_sizes(df, y)
    smallest = min(sizes.values())
    u = draw(id_col, "under", seed)
    names = {f"c{i}": label for i, label in enumerate(sizes)}
    draws = {n: F.when(F.col(y).eqNullSafe(F.lit(label)), u) for n, label in names.items()}
    chosen = lowest(df, id_col, draws, dict.fromkeys(names, smallest))
    return df.filter(reduce(Column.__or__, chosen.values()))


def _class_sizes(df: DataFrame, y: str) -> dict:
    """Rows per class: one row per class comes to the driver."""
    return {r[y]: r["count"] for r in df.groupBy(y).count().orderBy(y).collect()}


def oversample(df: DataFrame, y: str, id_col: str, seed: int = 0) -> DataFrame:
    """Raise every class to the size of the largest by repeating rows (drawn with replacement).

    Adds ``copy``: 0 for original rows, 1.. for the repeats of a class.
    """
    ranked = rank_by_draw(df.withColumn("_u", draw(id_col, "over", seed)), "_u", id_col, [y], "_rn")
    sizes = _class_sizes(df, y)
    top = max(sizes.values())
    spark = df.sparkSession
    wanted = []
    for label, n in sizes.items():
        if n < top:
            extra = spark.range(1, top - n + 1).withColumnRenamed("id", "copy")
            key = F.concat_ws(":", F.lit(str(label)), F.col("copy").cast("string"))
            at = (F.floor(draw(key, "over-pick", seed) * n) + 1).cast("long")
            wanted.append(extra.select(F.lit(label).cast(df.schema[y].dataType).alias(y), at.alias("_rn"), "copy"))
    originals = df.withColumn("copy", F.lit(0).cast("long"))
    if not wanted:
        return originals
    picks = reduce(DataFrame.unionByName, wanted)
    repeats = ranked.join(picks, [y, "_rn"]).select(*df.columns, "copy")
    return originals.unionByName(repeats)


def stratified_folds(df: DataFrame, id_col: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """(id, y, fold): every row is test in one fold, class counts per fold differ by at most 1."""
    u = df.select(id_col, y).withColumn("_u", draw(id_col, "fold", seed))
    ranked = rank_by_draw(u, "_u", id_col, [y], "_rn")
    return ranked.select(id_col, y, ((F.col("_rn") - 1) % k).cast("int").alias("fold"))


def fold_roles(folds: DataFrame, id_col: str, k: int, train_fraction: float, seed: int = 42) -> DataFrame:
    """(fold, id, role): the shuffled rest of each fold is cut into train and validation."""
    folds = cut(folds.select(id_col, "fold"))
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}  # k rows
    total = sum(sizes.values())
    draws, wanted = {}, {}
    for f in range(k):
        u = draw(F.concat_ws(":", F.lit(str(f)), F.col(id_col).cast("string")), "cut", seed)
        draws[f"f{f}"] = F.when(F.col("fold") != f, u)
        wanted[f"f{f}"] = int((total - sizes.get(f, 0)) * train_fraction)
    train = lowest(folds, id_col, draws, wanted)
    entries = [
        F.struct(
            F.lit(f).alias("fold"),
            F.when(F.col("fold") == f, "test").when(train[f"f{f}"], "train").otherwise("val").alias("role"),
        )
        for f in range(k)
    ]
    return folds.select(id_col, F.inline(F.array(*entries))).select("fold", id_col, "role")


def custom_split(df: DataFrame, split: SplitFn) -> DataFrame:
    """Caller-provided split; it must return fold, id and role."""
    out = split(df)
    missing = {"fold", "role"} - set(out.columns)
    if missing:
        raise ValueError(f"split function must return columns fold and role, missing {sorted(missing)}")
    return out


def split_xy(df: DataFrame, folds: DataFrame, id_col: str, fold: int, role: str, features: list[str], y: str) -> DataFrame:
    ids = folds.filter((F.col("fold") == fold) & (F.col("role") == role)).select(id_col)
    return df.join(ids, id_col, "left_semi").select(id_col, *features, y)


def split_grouped(df: DataFrame, subject: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """(fold, subject, role) with whole subjects kept together.

    Folds take equal numbers of each class; of the other subjects of a fold the
    first half of each class is train, the rest validation.
    """
    subjects = df.groupBy(subject).agg(F.max(y).alias(y))
    u = subjects.withColumn("_u", draw(subject, "group-fold", seed))
    ranked = rank_by_draw(u, "_u", subject, [y], "_rn")
    own = ranked.select(subject, y, ((F.col("_rn") - 1) % k).cast("int").alias("_own"))
    spread = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    key = F.concat_ws(":", F.col("fold").cast("string"), F.col(subject).cast("string"))
    rest = spread.filter("fold != _own").withColumn("_u", draw(key, "group-cut", seed))
    cut = rank_by_draw(rest, "_u", subject, ["fold", y], "_rn")
    role = F.when(F.col("_rn") <= F.floor(F.col("group_size") / 2), "train").otherwise("val")
    test = own.select(F.col("_own").alias("fold"), subject, F.lit("test").alias("role"))
    return cut.select("fold", subject, role.alias("role")).unionByName(test)


def split_random(df: DataFrame, id_col: str, test_fraction: float, seed: int = 42) -> DataFrame:
    role = F.when(draw(id_col, "split", seed) < test_fraction, "test").otherwise("train")
    return df.withColumn("role", role)


def split_ids_half(df: DataFrame, subject: str, seed: int = 42) -> DataFrame:
    """(subject, role): half of the distinct subjects train, half validation."""
    ids = df.select(subject).distinct()
    first = lowest(ids, subject, {"u": draw(subject, "half", seed)}, {"u": ids.count() // 2})["u"]
    return ids.select(subject, F.when(first, "train").otherwise("val").alias("role"))


def hide_panel_rows(
    df: DataFrame, features: list[str], id_col: str, n: int | None = None, fraction: float | None = None, seed: int = 0
) -> DataFrame:
    """The same exactly n random rows lose all listed features."""
    count = n if n is not None else int(df.count() * fraction)
    hide = lowest(df, id_col, {"u": draw(id_col, "panel", seed)}, {"u": count})["u"]
    return df.select(*[F.when(~hide, F.col(x)).alias(x) if x in features else F.col(f"`{x}`") for x in df.columns])


def hide_fixed_count(df: DataFrame, features: list[str], id_col: str, rate: float, seed: int = 0) -> DataFrame:
    """Exactly int(rate * n) nulls in each listed column, rows drawn per column."""
    quota = int(rate * df.count())
    hidden = lowest(df, id_col, {x: draw(id_col, f"count:{x}", seed) for x in features}, dict.fromkeys(features, quota))
    return df.select(*[F.when(~hidden[x], F.col(x)).alias(x) if x in features else F.col(x) for x in df.columns])


def take_first(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rank_in_small_group(df: DataFrame, group: list[str], order: list, out: str = "rn") -> DataFrame:
    """Plain window rank, for groups bounded by construction (models of a run, features of a row)."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
