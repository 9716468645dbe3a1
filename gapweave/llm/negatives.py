"""Hard-negative mining by the threshold algorithm.

Candidates lie in shards, cut from an order by label. A shard has one list for each dimension, its rows sorted by that
component. An anchor reads the lists from the end that the sign of its own component favours, some rows deeper at a
time, and scores every row it meets by random access. What the lists show at the present depth bounds the score of all
rows not met, the threshold. The search ends when the threshold is strictly below what each window still needs: the
score of its k-th row, or its lower edge while it has fewer. An equal score is never cut off, as ties are settled by id.

A first round finds each anchor's positives in the shards that hold its label. Their scores give the windows. A second
round visits about the root of the number of shards; the k-th scores it finds raise the lower edges for the last round, in which blocks of
anchors meet all other shards. A shard is shuffled once a round, and blocks of anchors, a small part of the rows, come to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import spill
from gapweave.llm.topk import usable

#: Candidates of a shard, anchors of a block, and rows of each list that are read first.
SHARD = 4096
BLOCK = 256
FIRST_STEP = 32
#: Whole numbers below this are exact as doubles; beyond, Python's integers are used.
EXACT = 2.0**53


class Shard:
    """Candidates with whole-numbered components and, for every dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.lists = np.argsort(x, axis=0, kind="stable").T
        self.most = float(np.abs(x).max()) if x.size else 0.0

    def exactly(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Components of the rows and of an anchor, in a type that holds sums of their products."""
        if self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT:
            return self.x, q
        whole = np.frompyfunc(int, 1, 1)
        return whole(self.x), whole(q)

    def search(self, q: np.ndarray, fits: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best rows of each window (low, high), of the rows that ``fits`` marks."""
        x, q = self.exactly(q)
        n, used = len(self.ids), np.flatnonzero(q)
        weight, up = q[used], q[used] < 0  # a negative component favours small values
        seen, depth, step = np.zeros(n, bool), 0, FIRST_STEP
        best = [(self.ids[:0], x[:0] @ q)] * len(windows)
        searched = list(range(len(windows)))
        while depth < n:
            at = np.where(up, self.lists[used, depth], self.lists[used, n - 1 - depth])
            threshold = (weight * x[at, used]).sum()
            needed = [max(windows[w][0], best[w][1][-1]) if len(best[w][0]) == k else windows[w][0] for w in searched]
            searched = [w for w, least in zip(searched, needed, strict=True) if not threshold < least]
            if not searched:
                break
            to = min(n, depth + step)
            met = np.full(n, not len(used))  # without a list to read, every row scores 0
            met[self.lists[used[up], depth:to].ravel()] = True
            met[self.lists[used[~up], n - to : n - depth].ravel()] = True
            fresh = np.flatnonzero(met & ~seen & fits)
            seen |= met
            depth, step = to, step * 2
            scores, ids = x[fresh] @ q, self.ids[fresh]
            for w in searched:
                inside = (scores >= windows[w][0]) & (scores <= windows[w][1])
                if inside.any():
                    best[w] = first(np.append(best[w][0], ids[inside]), np.append(best[w][1], scores[inside]), k)
        return best


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores in order, ties by smaller id."""
    if len(ids) > 8 * k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond become the nearest."""
    if scores.dtype == object:
        scores = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores], object)
    return scores.astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Whole-numbered components, in 16 bits where they all fit."""
    return b"s" + x.astype(np.int16).tobytes() if np.abs(x).max(initial=0) < 2**15 else b"d" + x.tobytes()


def _components(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw[1:], np.int16 if raw[:1] == b"s" else np.float64).reshape(rows, -1).astype(np.float64)


def _bundles(rows: DataFrame, size: int, parts: int, scale: int) -> DataFrame:
    """Rows (id, label, dim, v), in order of their labels, in bundles (no, dim, n, ids, labels, x, held) of up to
    ``size`` rows; held lists the labels in a bundle. A label of any number of rows is cut as the others are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def close(dim: int) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(z) for z in zip(*waiting.pop(dim), strict=True))
            data = [pa.array([z], pa.binary()) for z in (ids.tobytes(), labels.tobytes(), _packed(x))]
            columns = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *data, pa.array([np.unique(labels)], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["dim", "n", "ids", "labels", "x", "held"])

        for batch in batches:
            dims, ids, labels = (batch.column(c).to_numpy() for c in ("dim", "id", "label"))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.floor(batch.column("v").take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim) * scale)
                at = 0
                while at < len(own):
                    part = waiting.setdefault(dim, [])
                    to = at + size - sum(len(p[0]) for p in part)
                    part.append((ids[own[at:to]], labels[own[at:to]], x[at:to]))
                    at = to
                    if sum(len(p[0]) for p in part) >= size:
                        yield close(dim)
        for dim in sorted(waiting):
            yield close(dim)

    dealt = rows.repartitionByRange(parts, "label", F.xxhash64("id")).sortWithinPartitions("label")
    made = dealt.mapInArrow(pack, "dim int, n int, ids binary, labels binary, x binary, held array<long>")
    return spill(made.withColumn("no", F.monotonically_increasing_id()))


def _visit(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, same: bool, k: int, low: int, high: int, parts: int) -> DataFrame:
    """(block, at, anchor_id, w, id, score): the k best rows of a shard in each window, for pairs (shard, block).

    ``blocks`` has wants, the windows (at, w, p, edge) of its anchors: low * p <= 100 * score <= high * p and score >=
    edge; the one window of all scores where wants is null. ``same`` asks for rows of the anchor's label, else of others.
    """
    wants = "array<struct<at:int,w:int,p:long,edge:long>>"
    given = shards.select(F.col("no").alias("shard"), F.lit(-1).cast("long").alias("block"), "n", "ids", "labels", "x", F.lit(None).cast(wants).alias("wants"))
    asked = pairs.join(blocks, "block").select("shard", "block", "n", "ids", "labels", "x", F.col("wants").cast(wants).alias("wants"))
    met = given.join(pairs.select("shard").distinct(), "shard", "left_semi").unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            for place in range(batch.num_rows):
                r = batch.slice(place, 1).to_pylist()[0]
                ids, labels, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), _components(r["x"], r["n"])
                if r["block"] < 0:
                    now, shard = r["shard"], Shard(ids, labels, x)
                    continue
                assert r["shard"] == now
                windows: dict[int, list[tuple[int, float, float]]] = {}
                if r["wants"] is None:
                    windows = {a: [(0, float("-inf"), float("inf"))] for a in range(r["n"])}
                else:
                    for want in r["wants"]:
                        least, most = -(-low * want["p"] // 100), high * want["p"] // 100
                        least = least if want["edge"] is None else max(least, want["edge"])
                        windows.setdefault(want["at"], []).append((want["w"], least, most))
                out = []
                for a, asks in windows.items():
                    fits = (shard.labels == labels[a]) == same
                    if same:
                        fits &= shard.ids != ids[a]
                    if fits.any():
                        found = shard.search(x[a], fits, [(least, most) for _, least, most in asks], k)
                        out += [(a, ids[a], w, i, _long(s)) for (w, _, _), (i, s) in zip(asks, found, strict=True) if len(i)]
                sizes = [len(o[3]) for o in out]
                each = [np.repeat(np.array([o[c] for o in out], t), sizes) for c, t in ((0, np.int32), (1, np.int64), (2, np.int32))]
                flat = [np.concatenate([np.zeros(0, np.int64), *(o[c] for o in out)]) for c in (3, 4)]
                columns = [np.full(sum(sizes), r["block"], np.int64), *each, *flat]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "at", "anchor_id", "w", "id", "score"])

    dealt = met.repartition(parts, "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, "block long, at int, anchor_id long, w int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window, of what all shards gave."""
    order = Window.partitionBy("block", "at", "w").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    k: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: hard negatives of every anchor.

    Components x become floor(scale * x); scores are integer inner products of vectors of equal length. A row's first
    ``positives`` rows of its own label are its positives; for each, the first ``k`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned. Higher scores come
    first, ties by smaller id. ``anchors`` is a condition on ``rows``.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. An anchor is never its
    own positive, nor is another row of its id; apart from that repeated rows are candidates, and anchors, of their
    own. Labels that are no whole numbers are compared by 64-bit hashes. Scores beyond 64 bits are compared exactly
    within a shard and returned as the nearest 64-bit number. Other columns are not read; no rows give none.
    """
    spark = rows.sparkSession
    whole = dict(rows.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint")
    label = F.col(label_col).cast("long") if whole else F.xxhash64(F.col(label_col))
    given = F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    plain = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors & given, F.lit(False)).alias("asks"), given.alias("given"))
    plain = plain.filter(F.col("given") & usable(F.col("v"))).withColumn("dim", F.size("v"))
    total, asking = plain.agg(F.count("*"), F.count_if("asks")).first()
    many = max(1, -(-total // shard))
    parts = max(1, min(many, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shards = _bundles(plain, shard, many, scale)
    blocks = _bundles(plain.filter("asks"), block, max(1, -(-asking // (4 * block))), scale).withColumnRenamed("no", "block")

    number = shards.count()
    # of S shards, R first ones leave about k / R of a window's k best to beat in each of the rest: least for R near the root
    scouts = max(2, math.isqrt(number))

    by_label = shards.select(F.col("no").alias("shard"), "dim", F.explode("held").alias("label"))
    same = spill(by_label.join(blocks.select("block", "dim", F.explode("held").alias("label")), ["dim", "label"]).select("shard", "block").distinct())
    nothing = blocks.withColumn("wants", F.lit(None))
    found = _ranked(_visit(shards, nothing, same, True, positives, low, high, parts), positives)
    positive = spill(found.select("block", "at", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("p")))

    def with_windows(edges: DataFrame | None) -> DataFrame:
        each = positive.withColumn("edge", F.lit(None).cast("long")) if edges is None else positive.join(edges, ["block", "at", "w"], "left")
        return blocks.join(each.groupBy("block").agg(F.collect_list(F.struct("at", "w", "p", "edge")).alias("wants")), "block")

    pairs = shards.select(F.col("no").alias("shard"), "dim").join(blocks.select("block", "dim"), "dim")
    scout = F.pmod(F.xxhash64("shard", "block"), F.lit(max(1, number))) < scouts
    early = spill(_visit(shards, with_windows(None), pairs.filter(scout).select("shard", "block"), False, k, low, high, parts))
    edges = _ranked(early, k).filter(F.col("rank") == k).select("block", "at", "w", F.col("score").alias("edge"))
    late = _visit(shards, with_windows(edges), pairs.filter(~scout).select("shard", "block"), False, k, low, high, parts)
    best = _ranked(early.union(late), k).join(positive, ["block", "at", "w"])
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
