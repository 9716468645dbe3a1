"""Reshaping of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], cols: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, variable, value)


def pivot_first(df: DataFrame, rows: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """Given column names spare the extra job that finds them."""
    return df.groupBy(*rows).pivot(column, names).agg(F.first(value))


def transpose(df: DataFrame, key: str, cols: list[str], keys: list, out_key: str) -> DataFrame:
    long = melt(df, [key], cols, out_key, "_v")
    return long.groupBy(out_key).pivot(key, keys).agg(F.first("_v"))


def performance_matrix(df: DataFrame, fraction: str, n_features: str, value: str, size: int = 9) -> DataFrame:
    """Row = trunc(10 * fraction - 1), column = n_features - 1; empty cells are 0."""
    cell = df.select(
        (F.col(fraction) * 10 - 1).cast("int").alias("i"), (F.col(n_features) - 1).cast("int").alias("j"), F.col(value).alias("v")
    )
    return cell.groupBy("i").pivot("j", list(range(size))).agg(F.last("v")).na.fill(0.0)


def symmetric_matrix(pairs: DataFrame, a: str, b: str, value: str, names: list[str]) -> DataFrame:
    both = pairs.select(a, b, value).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), value))
    return both.groupBy(a).pivot(b, names).agg(F.first(value))
