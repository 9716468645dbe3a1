"""Projections, filters and encodings used to clean a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.functions.scalar import c
from gapweave.operators.hotjoin import lookup
from gapweave.session import fits

BROADCAST_LABELS = 200_000

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


@dataclass
class Panel:
    """A named group of features that are ordered (and missing) together."""

    name: str
    features: list[str] = field(default_factory=list)
    source: str = ""
    cost: float = 0.0

    def add(self, features: Iterable[str]) -> Panel:
        return Panel(self.name, [*self.features, *features], self.source, self.cost)

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*self.features)


def panel_table(spark, panels: Iterable[Panel]) -> DataFrame:
    rows = [(p.name, list(p.features), p.source, float(p.cost)) for p in panels]
    return spark.createDataFrame(rows, "panel string, features array<string>, source string, cost double")


def panel_lookup(panels: DataFrame) -> DataFrame:
    """feature -> panel."""
    return panels.select(F.explode("features").alias("feature"), "panel")


def drop_by_rule(df: DataFrame, rule: Callable[[str], bool]) -> DataFrame:
    return df.select(*[name for name in df.columns if not rule(name)])


def rename(df: DataFrame, names: Mapping[str, str] | list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names)) if isinstance(names, Mapping) else df.toDF(*names)


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, nulls, n_rows) from one aggregate pass."""
    cols = cols or df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(x).isNull()).alias(x) for x in cols]
    )
    return one.unpivot(["n_rows"], cols, "feature", "nulls").select("feature", "nulls", "n_rows")


def columns_without_nulls(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    cols = cols or df.columns
    row = df.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in cols]).first()
    return [x for x in cols if row[x] == 0]


def rows_with_any(df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """Ids of rows where at least one listed feature is present."""
    return df.na.drop("all", subset=features).select(id_col)


def complete_rows(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=features)


def base_features(df: DataFrame, panels: Iterable[Panel], target: str, id_col: str) -> list[str]:
    """Features outside every panel."""
    inside = {f for p in panels for f in p.features}
    return [x for x in df.columns if x not in inside and x not in (target, id_col)]


def panels_from_names(columns: Iterable[str]) -> list[Panel]:
    """Panels named by what follows the first underscore of a column name."""
    groups: dict[str, list[str]] = {}
    for name in columns:
        if "_" in name:
            groups.setdefault(name.split("_")[1], []).append(name)
    return [Panel(k, v) for k, v in groups.items()]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def binarise(x: str | Column, zero: object, negative: int = 0) -> Column:
    """``negative`` where x equals ``zero``, else 1."""
    return F.when(c(x) == F.lit(zero), negative).otherwise(1)


def bracket_digit(x: str | Column) -> Column:
    """Second character of a bracket such as '[70-80)', as a number."""
    return F.substring(c(x), 2, 1).cast("int")


def remask(df: DataFrame, original: Mapping[str, str], out: Iterable[str] | None = None) -> DataFrame:
    """Null out encoded columns wherever the column they came from was null."""
    fixed = {new: F.when(F.col(old).isNull(), None).otherwise(F.col(new)) for new, old in original.items()}
    df = df.withColumns(fixed)
    return df.select(*out) if out else df


@dataclass
class LabelCodes:
    """Codes by sorted order of the distinct labels, one table for all columns."""

    codes: DataFrame  # feature, label, code
    small: bool = False  # counted: small enough to be sent to every task

    def for_column(self, name: str) -> DataFrame:
        table = self.codes.filter(F.col("feature") == name).select("label", "code")
        return F.broadcast(table) if self.small else table

    def encode(self, df: DataFrame, name: str, out: str | None = None, keep: bool = False) -> DataFrame:
        key = F.col(f"`{name}`").cast("string")
        table = self.for_column(name).withColumnsRenamed({"label": "_label", "code": "_code"})
        joined = df.join(table, key == F.col("_label"), "left") if self.small else lookup(df, table, key, "_label")
        target = out or name
        rest = [F.col(f"`{x}`") for x in df.columns if x != target and (keep or x != name)]
        return joined.select(*rest, F.col("_code").alias(target))

    def decode(self, df: DataFrame, code_col: str, name: str, out: str = "label") -> DataFrame:
        table = self.for_column(name).withColumnsRenamed({"label": out, "code": "_code"})
        if not self.small:
            return lookup(df, table, F.col(code_col).cast("int"), "_code")
        return df.join(table, F.col(code_col) == F.col("_code"), "left").drop("_code")


def label_codes(df: DataFrame, cols: list[str]) -> LabelCodes:
    """Rank of each distinct label of each column, 0-based.

    All columns share one unpivot and one distinct; the ranking then sees only
    distinct labels (numbers by value, text by code point). It sorts them with
    a distributed sort, so a column with very many labels does not end in a
    single task.
    """
    from gapweave.operators.ordered import ordinal_in_group

    numeric = set(numeric_columns(df))
    entries = [
        F.struct(
            F.lit(x).alias("feature"),
            F.col(f"`{x}`").cast("string").alias("label"),
            (F.col(f"`{x}`").cast("double") if x in numeric else F.lit(None).cast("double")).alias("_num"),
        )
        for x in cols
    ]
    labels = df.select(F.inline(F.array(*entries))).filter(F.col("label").isNotNull()).distinct()
    ranked = ordinal_in_group(labels, ["feature"], ["_num", "label"], "_rn")
    codes = ranked.select("feature", "label", (F.col("_rn") - 1).cast("int").alias("code"))
    return LabelCodes(codes, fits(codes, BROADCAST_LABELS))


def one_hot(x: str | Column, categories: list) -> Column:
    """Indicator vector, categories ascending."""
    return F.array(*[F.when(c(x) == F.lit(v), 1.0).otherwise(0.0) for v in sorted(categories)])


@dataclass
class MinMax:
    low: dict[str, float]
    high: dict[str, float]

    def column(self, name: str) -> Column:
        lo, hi = self.low[name], self.high[name]
        if lo is None or hi == lo:
            return F.when(F.col(name).isNotNull(), F.lit(0.0))
        return (F.col(name) - F.lit(lo)) / F.lit(hi - lo)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.column(name) for name in self.low})


def fit_minmax(df: DataFrame, cols: list[str]) -> MinMax:
    row = df.agg(
        *[F.min(F.col(x).cast("double")).alias(f"lo_{x}") for x in cols],
        *[F.max(F.col(x).cast("double")).alias(f"hi_{x}") for x in cols],
    ).first()
    return MinMax({x: row[f"lo_{x}"] for x in cols}, {x: row[f"hi_{x}"] for x in cols})


def round_features(df: DataFrame, cols: list[str], digits: int = 8) -> DataFrame:
    return df.withColumns({x: F.bround(F.col(x), digits) for x in cols})


def surrogate_ids(df: DataFrame, order: list[str], offset: int = 0, out: str = "row_id") -> DataFrame:
    """New ids by position, starting at ``offset``."""
    from gapweave.operators.ordered import ordinal

    return ordinal(df, order, "_rn").withColumn(out, F.col("_rn") - 1 + F.lit(offset)).drop("_rn")


def experiment_fraction(name: str | Column) -> Column:
    """Fraction in 'amount(0.3)__features([...])'."""
    return F.regexp_extract(c(name), r"amount\(([0-9.]+)\)", 1).cast("double")


def experiment_feature_count(name: str | Column) -> Column:
    inner = F.regexp_extract(c(name), r"features\(\[(.*)\]\)", 1)
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))


def rate_of_metric(name: str | Column) -> Column:
    """Trailing digits of a metric name such as 'roc_auc_30'."""
    return F.regexp_extract(c(name), r"(\d+)$", 1).cast("int")


def display_order(name: str | Column) -> Column:
    """Sort key of model names in reports."""
    # fixed values: marker and position; the first marker found decides, other names come first
    order = [("knn", 5), ("mice", 4), ("vanilla", 3), ("stacked", 2), ("inheritance", 1)]
    out = None
    for marker, pos in order:
        hit = c(name).contains(marker)
        out = F.when(hit, pos) if out is None else out.when(hit, pos)
    return out.otherwise(0)


def band_of(x: str | Column) -> Column:
    """Result bands: below 0.6, 0.6 to 0.7, from 0.7."""
    return F.when(c(x) < 0.6, "low").when(c(x) < 0.7, "mid").otherwise("high")


def metric_columns(columns: Iterable[str], metric: str) -> list[str]:
    return [x for x in columns if metric in x and "oracle" not in x]
