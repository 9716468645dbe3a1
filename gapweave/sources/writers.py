"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_run_tables(tables: dict[str, DataFrame], root: str, partition: list[str] | None = None, csv: bool = False) -> dict[str, str]:
    """One folder per table, partitioned by the parameters of the run."""
    paths = {}
    for name, df in tables.items():
        path = f"{root}/{name}"
        keys = [p for p in (partition or []) if p in df.columns]
        writer = df.write.mode("overwrite")
        if keys:
            writer = writer.partitionBy(*keys)
        if csv:
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)
        paths[name] = path
    return paths


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, header: bool = True, **options) -> None:
    w = df.write.mode("overwrite").option("header", header)
    for k, v in options.items():
        w = w.option(k, v)
    w.csv(path)
