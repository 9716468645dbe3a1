"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors within a cosine are within a distance of each other, and a projection never makes distances
larger. So vectors are sorted by the grid cells (side: that distance) of their leading principal dimensions
and cut into blocks of the sequence. Intervals of the sequence are joined recursively, from few long ones down
to blocks; a pair of intervals whose boxes are too far apart is dropped with all below it. Pairs of blocks that
remain are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import spill, unit_draw
from gapweave.llm.components import components

DIMS = 4
BLOCK = 1024
FAN = 16
#: Vectors drawn for the principal directions. Any orthonormal directions give right results.
SAMPLE = 10_000


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components and not of length zero."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _units(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(vectors: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """Leading principal directions of a drawn sample, for its most frequent length."""
    drawn = vectors.filter(unit_draw("rep", seed=4) < SAMPLE / max(rows, 1)).select("dim", "v").toArrow()
    dims = np.array(drawn["dim"].to_pylist(), dtype=np.int64)
    if not len(dims):
        return 0, np.zeros((0, DIMS))
    d = int(np.bincount(dims).argmax())
    x = _units(drawn["v"].combine_chunks().filter(pa.array(dims == d)), d)
    _, _, axes = np.linalg.svd(np.cov(x, rowvar=False).reshape(d, d) if len(x) > 1 else np.eye(d))
    return d, axes[:DIMS].T


def _blocks(vectors: DataFrame, eps: float, rows: int) -> DataFrame:
    """Blocks of the sorted sequence: label, dim, part, local, box (lo0, hi0, ...), ids, counts and unit vectors as bytes."""
    common, axes = _directions(vectors, rows)

    def project(x: np.ndarray) -> np.ndarray:
        p = x @ axes if x.shape[1] == common else x[:, :DIMS]
        return np.pad(p, ((0, 0), (0, DIMS - p.shape[1])))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                p = project(_units(own.column("v"), int(d)))
                cell = np.floor(p / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(cell[:, k]) for k in range(DIMS))], [*own.schema.names, *(f"c{k}" for k in range(DIMS))])

    order = ["label", "dim", *(f"c{k}" for k in range(DIMS)), "rep"]
    celled = vectors.mapInArrow(cells, "label long, dim int, rep long, n long, v array<double>, " + ", ".join(f"c{k} int" for k in range(DIMS)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # pieces of the block that is being filled
        key, size = None, 0

        def close() -> pa.RecordBatch:
            ids, counts, x = (np.concatenate(z) for z in zip(*held, strict=True))
            p = project(x)
            box = [pa.array([float(f(p[:, k]))]) for k in range(DIMS) for f in (np.min, np.max)]
            first = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([part], pa.int64()), pa.array([local], pa.int64())]
            data = [pa.array([z.tobytes()], pa.binary()) for z in (ids, counts, x)]
            names = ["label", "dim", "part", "local", *(f"{e}{k}" for k in range(DIMS) for e in ("lo", "hi")), "ids", "counts", "x"]
            return pa.RecordBatch.from_arrays([*first, *box, *data], names)

        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            edges = np.flatnonzero((np.diff(labels) != 0) | (np.diff(dims) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(labels)], strict=True):
                if a == b:
                    continue
                d = int(dims[a])
                if key != (int(labels[a]), d):
                    if held:
                        yield close()
                        held, size, local = [], 0, local + 1
                    key = (int(labels[a]), d)
                run = batch.slice(a, b - a)
                ids, counts, x = run.column("rep").to_numpy(), run.column("n").to_numpy(), _units(run.column("v"), d)
                at = 0
                while at < len(ids):
                    take = min(BLOCK - size, len(ids) - at)
                    held.append((ids[at : at + take], counts[at : at + take], x[at : at + take]))
                    size, at = size + take, at + take
                    if size == BLOCK:
                        yield close()
                        held, size, local = [], 0, local + 1
        if held:
            yield close()

    box = ", ".join(f"{e}{k} double" for k in range(DIMS) for e in ("lo", "hi"))
    return celled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"label long, dim int, part long, local long, {box}, ids binary, counts binary, x binary")


def _near(eps: float) -> Column:
    """Boxes of x and y are not provably farther apart than ``eps`` (with a little room for rounding)."""
    gap = [F.greatest(F.lit(0.0), F.col(f"x.lo{k}") - F.col(f"y.hi{k}"), F.col(f"y.lo{k}") - F.col(f"x.hi{k}")) for k in range(DIMS)]
    return sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= (eps * (1 + 1e-9) + 1e-9) ** 2


def _block_pairs(blocks: DataFrame, eps: float, count: int) -> DataFrame:
    """(a, b) numbers of the blocks to compare, a <= b, by joining intervals level by level."""
    boxes = [f"{e}{k}" for k in range(DIMS) for e in ("lo", "hi")]
    levels = max(1, math.ceil(math.log(max(count, 2), FAN)))

    def nodes(level: int) -> DataFrame:
        at = F.floor(F.col("no") / FAN**level)
        bounds = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in boxes]
        return blocks.groupBy("label", "dim", at.alias("no")).agg(*bounds).withColumn("up", F.floor(F.col("no") / FAN))

    top = nodes(levels)
    pairs = top.alias("x").join(top.alias("y"), ["label", "dim"]).filter("x.no <= y.no").filter(_near(eps)).select("label", "dim", F.col("x.no").alias("a"), F.col("y.no").alias("b"))
    for level in reversed(range(levels)):
        below = nodes(level)
        x, y, p = below.alias("x"), below.alias("y"), pairs.alias("p")
        same = lambda z: (F.col(f"{z}.label") == F.col("p.label")) & (F.col(f"{z}.dim") == F.col("p.dim"))
        pairs = (
            p.join(x, same("x") & (F.col("x.up") == F.col("p.a"))).join(y, same("y") & (F.col("y.up") == F.col("p.b")))
            .filter("x.no <= y.no").filter(_near(eps)).select("p.label", "p.dim", F.col("x.no").alias("a"), F.col("y.no").alias("b"))
        )
    return pairs.select("a", "b")


def _linked(xa: np.ndarray, xb: np.ndarray, least: float) -> np.ndarray:
    cos = xa @ xb.T
    hit = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):  # rounding could decide: sum exactly
        hit[i, j] = math.fsum(xa[i] * xb[j]) >= least
    return hit


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Per block pair and vector with links: how many vectors it links with there, and the smallest id it
    reaches there. Links themselves are not emitted, so a dense pair of blocks gives no more rows than vectors."""
    for batch in batches:
        for r in batch.to_pylist():
            ida, idb = np.frombuffer(r["ids_a"], np.int64), np.frombuffer(r["ids_b"], np.int64)
            na, nb = np.frombuffer(r["counts_a"], np.int64), np.frombuffer(r["counts_b"], np.int64)
            hit = _linked(np.frombuffer(r["x_a"]).reshape(len(ida), -1), np.frombuffer(r["x_b"]).reshape(len(idb), -1), least)
            own = r["a"] == r["b"]
            if own:
                hit |= hit.T
                np.fill_diagonal(hit, False)
            ra, rb = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if not len(ra):
                continue
            links_a, links_b = (hit @ nb)[ra], (na @ hit)[rb]
            hit = hit[np.ix_(ra, rb)]
            ida, idb = ida[ra], idb[rb]
            low_a, low_b, far = ida.copy(), idb.copy(), np.iinfo(np.int64).max
            while True:
                new_a = np.minimum(low_a, np.where(hit, low_b, far).min(axis=1))
                new_b = np.minimum(low_b, np.where(hit, new_a[:, None], far).min(axis=0))
                if own:
                    new_a = new_b = np.minimum(new_a, new_b)
                if (new_a == low_a).all() and (new_b == low_b).all():
                    break
                low_a, low_b = new_a, new_b
            sides = [(ida, links_a, low_a)] if own else [(ida, links_a, low_a), (idb, links_b, low_b)]
            ids, links, low = (np.concatenate(z) for z in zip(*sides, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(low)], ["rep", "links", "low"])


def near_duplicates(rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The id, n_links, component_id, kept and class_id (the smallest id with the same label and vector) per row.

    Vectors link when their labels and lengths are equal and their cosine is ``least`` (0 to 1) or more. Equal
    vectors are joined as one and counted. Null, empty or zero vectors, those with null or non-finite
    components, and rows with a null label or null id link with nothing: n_links 0, the component is the
    row itself. Repeated rows count as vectors of their own. Other columns are not read; no rows give none.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    base = base.withColumn("v", F.when(good, F.col("v")))
    reps = spill(base.filter(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    count = reps.count()
    vectors = reps.select("label", F.size("v").alias("dim"), "rep", "n", "v")
    blocks = spill(_blocks(vectors, eps, count))
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    spark = rows.sparkSession
    blocks = blocks.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part").withColumn("no", F.col("start") + F.col("local")).drop("part", "local", "start")
    pairs = _block_pairs(blocks, eps, at)
    side = lambda z: blocks.select(F.col("no").alias(z), *[F.col(c).alias(f"{c}_{z}") for c in ("ids", "counts", "x")])
    full = pairs.repartition("a", "b").join(side("a"), "a").join(side("b"), "b")
    met = spill(full.mapInArrow(lambda batches: _compare(batches, least), "rep long, links long, low long"))
    roots = components(met, "rep", "low").select(F.col("node").alias("rep"), "root")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.join(links, "rep", "left").join(roots, "rep", "left")
    known = known.select("label", "v", F.col("rep"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = base.join(known, ["label", "v"], "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.coalesce("rep", "id").alias("class_id"),
    )
