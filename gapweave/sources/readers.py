"""Readers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.session import cut, shuffle_width

# fixed values: measure and statistic names of the breast cancer tables
MEASURES = [
    "radius", "texture", "perimeter", "area", "smoothness",
    "compactness", "concavity", "concave points", "symmetry", "fractaldimension",
]
STATISTICS = ["mean", "stderr", "worst"]

# buckets of content-ordered ids (hex digits of the hash), and copies of one row that one task writes out
_BUCKET_DIGITS, _PIECE = 3, 1_000_000


def doubles(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def measure_columns() -> list[str]:
    """mean_radius .. worst_fractaldimension; the statistic is the outer loop."""
    return [f"{s}_{m}" for s in STATISTICS for m in MEASURES]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    header: bool = False,
    sep: str = ",",
    null_marker: str | None = None,
) -> DataFrame:
    reader = spark.read.schema(schema).option("header", header).option("sep", sep)
    if null_marker is not None:
        reader = reader.option("nullValue", null_marker)
    return reader.option("ignoreTrailingWhiteSpace", True).csv(path)


def read_positional(spark: SparkSession, path: str, n_cols: int, **options) -> DataFrame:
    """Headerless numbers; columns are named '0'..'n-1' and the last one is the target."""
    return read_csv(spark, path, doubles([str(i) for i in range(n_cols)]), **options)


def header_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a headed file (reads its first line)."""
    first = spark.read.text(path).first()[0]
    return [x.strip().strip('"') for x in first.rstrip("\r").split(sep)]


def read_headed(
    spark: SparkSession, path: str, types: dict[str, str] | None = None, default: str = "double", **options
) -> DataFrame:
    """Headed file; the type of each column is given by name, the rest take ``default``."""
    types = types or {}
    names = header_columns(spark, path, options.get("sep", ","))
    ddl = ", ".join(f"`{n}` {types.get(n, default)}" for n in names)
    return read_csv(spark, path, ddl, header=True, **options)


def read_tree(spark: SparkSession, root: str, file_name: str, schema: str, **options) -> DataFrame:
    """Every file of one name below a folder, with the folder it came from."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.csv(root)
    return df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Ids 0, 1, ... for a source that has none, in order of a hash of the row's content.

    They do not depend on files, splits or the order of rows, so draws keyed by them are the same however the source is
    read. Equal rows get ids next to each other. Equal rows are counted first; positions are those within a bucket of
    the hash plus the sizes of earlier buckets, so no task numbers the whole table. The result is written once.
    """
    names = df.columns
    marks = [F.when(F.col(f"`{c}`").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string"))) for c in names]
    counted = df.groupBy(*[f"`{c}`" for c in names]).agg(F.count(F.lit(1)).alias("_copies"))
    keyed = cut(counted.withColumn("_key", F.md5(F.concat_ws("|", *marks).cast("binary"))).withColumn("_bucket", F.substring("_key", 1, _BUCKET_DIGITS)))
    sizes = keyed.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))  # at most 16 ** _BUCKET_DIGITS rows
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_bucket").orderBy("_key", *[F.col(f"`{c}`") for c in names]).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(F.broadcast(starts), "_bucket")
    first = (F.col("_start") + F.col("_inside")).alias("_first")
    # a row with very many copies is spread over tasks in pieces
    pieces = placed.select(*[F.col(f"`{c}`") for c in names], first, "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / _PIECE))).alias("_piece"))
    pieces = pieces.repartition(shuffle_width(df.sparkSession))
    low = F.col("_piece") * _PIECE
    high = F.least(low + _PIECE, F.col("_copies")) - 1
    each = F.explode(F.sequence(F.col("_first") + low, F.col("_first") + high)).alias(out)
    return cut(pieces.select(*[F.col(f"`{c}`") for c in names], each))
