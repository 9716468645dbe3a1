"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into shards; a shard holds its vectors and, for every dimension, its rows in order of
that component. A query reads the lists from the end that its own component favours, in steps; every row met is
scored. No row that was not met can score more than the sum of what the lists show at the present depth, so
the search in a shard ends when the k-th best score is above that bound. Blocks of queries visit every shard
by an equi-join on the shard's number, and the k best of all shards are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import spill

SHARD = 4096
QUERIES = 512
FIRST_STEP = 32


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def threshold_search(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard for one query; ties go to the smaller id. ``lists`` holds, by
    dimension, row numbers in ascending order of the component."""
    n = len(ids)
    used = np.flatnonzero(q)
    seen = np.zeros(n, bool)
    if own is not None:
        seen |= ids == own
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    depth, step = 0, FIRST_STEP
    up = q[used] < 0  # a negative component favours small values
    weight = q[used]
    while depth < n:
        to = min(n, depth + step)
        met = np.zeros(n, bool)
        met[lists[used[up], depth:to].ravel()] = True
        met[lists[used[~up], n - to : n - depth].ravel()] = True
        if not len(used):
            met[:] = True
            to = n
        fresh = np.flatnonzero(met & ~seen)
        seen |= met
        best_ids, best = np.append(best_ids, ids[fresh]), np.append(best, x[fresh] @ q)
        if len(best) > k:
            cut = np.partition(best, len(best) - k)[len(best) - k]
            near = best >= cut
            best_ids, best = best_ids[near], best[near]
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
        depth, step = to, step * 2
        if depth < n and len(best) == k:
            at = np.where(up, lists[used, depth - 1], lists[used, n - depth])
            if best.min() > weight @ x[at, used]:  # an equal score could still win by its id
                break
    order = np.lexsort((best_ids, -best))[:k]
    return best_ids[order], best[order]


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(n, -1)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score: the k best rows for every query row.

    Components x become floor(scale * x); scores are integer inner products (64-bit) of vectors of equal
    length. A query meets every row but those of its own id; ties go to the smaller id. Null vectors, those
    with null or non-finite components, and rows with a null id take no part; an empty vector scores 0 with
    other empty ones; a repeated row is a candidate, or a query, of its own. Other columns are not read.
    """
    spark = rows.sparkSession

    def plain(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        df = df.filter(F.col("id").isNotNull() & usable(F.col("v")))
        return df.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))

    def packed(size: int, with_lists: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def close(d: int) -> pa.RecordBatch:
                ids, x = (np.concatenate(z) for z in zip(*held.pop(d), strict=True))
                lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32) if with_lists else np.zeros(0, np.int32)
                data = [pa.array([z.tobytes()], pa.binary()) for z in (ids, x, np.ascontiguousarray(lists))]
                return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), *data], ["dim", "n", "ids", "x", "lists"])

            for batch in batches:
                dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
                for d in np.unique(dims):
                    own = np.flatnonzero(dims == d)
                    x = batch.column("v").take(pa.array(own)).flatten().to_numpy().reshape(len(own), int(d))
                    for at in range(0, len(own), size):
                        part = held.setdefault(int(d), [])
                        part.append((ids[own[at : at + size]], x[at : at + size]))
                        if sum(len(z[0]) for z in part) >= size:
                            yield close(int(d))
            for d in sorted(held):
                yield close(d)

        return pack

    kinds = "dim int, n int, ids binary, x binary, lists binary"

    def blocks(df: DataFrame, size: int, with_lists: bool) -> DataFrame:
        df = plain(df)
        many = max(1, -(-df.count() // size))
        made = df.repartition(many).mapInArrow(packed(size, with_lists), kinds)
        return spill(made.withColumn("no", F.monotonically_increasing_id()))

    shards, asked = blocks(rows, SHARD, True), blocks(queries, QUERIES, False)
    numbers = shards.select("no", "dim")
    visits = asked.select("dim", F.col("no").alias("block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    visits = numbers.join(visits, "dim").join(shards.drop("dim"), "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x, lists = np.frombuffer(r["ids"], np.int64), _numbers(r["x"], r["n"]), np.frombuffer(r["lists"], np.int32).reshape(-1, r["n"])
                asking, q = np.frombuffer(r["q_ids"], np.int64), _numbers(r["q"], r["q_n"])
                if x.size and q.size and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**53:
                    x, q = x.astype(np.float64), q.astype(np.float64)  # whole numbers, exact and faster
                found = [threshold_search(x, ids, lists, q[i], int(asking[i]), k) for i in range(len(asking))]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(sum(sizes), r["block"], np.int64)), pa.array(np.repeat(np.arange(len(asking)), sizes)), pa.array(np.repeat(asking, sizes)),
                     pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))],
                    ["block", "at", "query_id", "id", "score"],
                )

    found = visits.repartition("no", "block").mapInArrow(run, "block long, at long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
