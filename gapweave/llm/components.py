"""Connected components of a link table, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import spill


def _towards_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step. ``edges`` hold u > v. The minimum of each node's neighbourhood is a partial
    aggregate, and neighbours meet it by a join, so that a node with many links is split by Spark."""
    if larger_only:  # every node, all its neighbours; the larger ones move to the minimum
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node it reaches.

    Large-star and small-star steps by turns until nothing moves: every round is a few
    joins over the links, none is sent to the driver, each round is written to the shared
    folder. Null ends and links of a node to itself count as no link; no link, no row.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = spill(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    while (here := state(now)) != before:
        before = here
        now = spill(_towards_minimum(_towards_minimum(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
