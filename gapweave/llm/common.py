"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Bits that mark wanted keys by their hash, and so many of them to a row (as bitmap_construct_agg has it).
MARKS, MARKS_ROW = 1 << 24, 1 << 15


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def spill(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and no later job computes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_types(df: DataFrame, *names: str) -> str:
    """DDL of some columns, for the output of Arrow functions."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the Python objects made of one slice stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_crc(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def unit_draw(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return (F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be in ``wanted``: every one that is, and some whose hash is marked by another.

    It spares a join most of the other rows. Marks are MARKS bits (2 MB) at most, so what is broadcast doesn't grow
    with the keys; the more keys, the more rows pass that a join must drop. A null key is in neither.
    """
    place = F.pmod(F.xxhash64(key, F.lit(21)), F.lit(MARKS))
    row, bit = F.floor(place / MARKS_ROW).cast("int"), F.pmod(place, F.lit(MARKS_ROW)).cast("long")
    marked = wanted.filter(F.col(key).isNotNull()).select(row.alias("_row"), bit.alias("_bit")).repartition("_row")  # bits move, not bitmaps
    marks = marked.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    placed = df.filter(F.col(key).isNotNull()).withColumns({"_row": row, "_bit": bit}).join(F.broadcast(marks), "_row")
    byte = F.expr("conv(hex(substring(_marks, cast(_bit div 8 as int) + 1, 1)), 16, 10)").cast("int")
    return placed.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0).select(*df.columns)
