"""Joins of rows with a large dictionary whose key is uneven: frequent keys are broadcast, the rest are shuffled.

Frequent keys are found by a counter of bounded size in every task (Misra and Gries 1982): it keeps a number of keys
and takes one from all when another comes, so a count is too low by at most rows / slots. Rows of frequent keys never
move: they meet the few dictionary rows of those keys, which are broadcast. No other key has so many rows that its
task would stand out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.scalar import c
from gapweave.session import cut

#: Share of the rows from which a key is frequent, and counters of a task for each such key.
SHARE, COUNTERS = 0.005, 4


class Counter:
    """Frequent values of a stream in at most ``slots`` counters; ``seen`` counts all values but nulls."""

    def __init__(self, slots: int):
        self.slots, self.seen, self.counts = slots, 0, {}

    def add(self, values: pa.Array) -> None:
        found = pc.value_counts(values.drop_null())
        counts = found.field("counts").to_numpy(zero_copy_only=False)
        self.seen += int(counts.sum())
        for value, n in zip(found.field("values").to_pylist(), counts.tolist(), strict=True):
            self.counts[value] = self.counts.get(value, 0) + n
        if len(self.counts) > self.slots:  # as much is taken from all as leaves ``slots`` of them
            least = int(np.partition(list(self.counts.values()), -self.slots - 1)[-self.slots - 1])
            self.counts = {v: n - least for v, n in self.counts.items() if n > least}


def frequent(df: DataFrame, key: str | Column, share: float = SHARE) -> DataFrame:
    """(key): every value of at least ``share`` of the rows with a key, and perhaps some of half as many.

    At most 2 / ``share`` rows. One scan of the key; a task hands on its counters only.
    """
    slots = int(COUNTERS / share)
    keys = df.select(c(key).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, kind = Counter(slots), None
        for batch in batches:
            kind = batch.schema.field("key").type
            counter.add(batch.column("key"))
        if counter.seen:
            every = [*counter.counts.items(), (None, counter.seen)]  # the null key carries the number of rows
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in every], kind), pa.array([n for _, n in every], pa.int64())], ["key", "n"])

    counted = cut(keys.mapInArrow(run, f"key {keys.dtypes[0][1]}, n long").groupBy("key").agg(F.sum("n").alias("n")))
    whole = counted.filter("key IS NULL").first()
    least = (whole["n"] if whole else 0) * share * (1 - 1 / COUNTERS)
    return counted.filter(F.col("key").isNotNull() & (F.col("n") >= F.lit(least))).select("key")


def lookup(rows: DataFrame, dictionary: DataFrame, key: str | Column, dictionary_key: str, share: float = SHARE) -> DataFrame:
    """``rows`` with the columns of ``dictionary`` (but its key), null where the key is not there; a left join.

    ``dictionary`` has each key once, and may be of any size. The frequent keys of ``rows`` are looked up in a broadcast
    part of it; all other rows are joined by a shuffle. Rows with a null key stay as they are.
    """
    spark = rows.sparkSession
    hot = [r["key"] for r in frequent(rows, key, share).collect()]  # at most 2 / share keys
    extra = [x for x in dictionary.columns if x != dictionary_key]
    if clash := set(extra) & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are on both sides")
    table = dictionary.withColumnRenamed(dictionary_key, "_dictionary_key")
    names = [F.col(f"`{x}`") for x in (*rows.columns, *extra)]
    if not hot:
        return rows.join(table, c(key) == F.col("_dictionary_key"), "left").select(*names)
    kind = dictionary.schema[dictionary_key].dataType.simpleString()
    some = spark.createDataFrame([(k,) for k in hot], f"_hot {kind}")
    few = F.broadcast(table.join(F.broadcast(some), F.col("_dictionary_key") == F.col("_hot"), "left_semi"))
    is_hot = F.coalesce(c(key).isin(hot) if len(hot) <= 64 else F.array_contains(F.array(*[F.lit(k) for k in hot]), c(key)), F.lit(False))
    near = rows.filter(is_hot).join(few, c(key) == F.col("_dictionary_key"), "left").select(*names)
    alone = c(key).isNull()
    far = rows.filter(~is_hot & ~alone).join(table.hint("shuffle_merge"), c(key) == F.col("_dictionary_key"), "left").select(*names)
    without = rows.filter(alone).select(*[F.col(f"`{x}`") for x in rows.columns], *[F.lit(None).cast(dictionary.schema[x].dataType).alias(x) for x in extra])
    return near.union(far).union(without)
