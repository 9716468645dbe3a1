"""Best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import keep_types, slices, spill
from gapweave.llm.tokens import library_encoder

#: Open bins of one packing task, and what one task packs at most (on average).
OPEN_BINS = 32_768
TASK_TOKENS = 1 << 27
TASK_PIECES = 1 << 20


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, followed by ``end_id``, into pieces of ``size``; the last may be shorter.

    Columns: the id, piece (from 0), start, length, ids_crc32 and, if asked for, ids (little-endian
    unsigned 32-bit). A null text is an empty one and gives the piece [end_id]; a null id stays null;
    repeated rows are cut one by one; other columns of ``docs`` are not read; no rows give no rows.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library_encoder(tokenizer)
        for batch in slices(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = known.encode(text or "") + end
                for k, start in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[start : start + 4 * size]
                    at.append(i)
                    rows.append((k, start // 4, len(part) // 4, zlib.crc32(part), part))
            k, start, length, crc, part = zip(*rows, strict=True) if rows else ((),) * 5
            out = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(part, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = f"{keep_types(source, 'id')}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return source.mapInArrow(cut, kinds).withColumnRenamed("id", id_col)


class BestFit:
    """Bounded-space online best fit. Open bins are kept by free space; a bitset tells which
    free spaces occur, so the tightest bin that fits is its lowest bit at or above the length.
    When a bin must be opened and all are in use, the fullest closes."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.in_use = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        n = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.in_use -= 1
        return n

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            n = self._take(free)
        else:
            if self.in_use >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            n, free, self.made = self.made, self.size, self.made + 1
        left = free - length
        if left:
            self.by_free[left].append(n)
            self.bits |= 1 << left
            self.in_use += 1
        return n, self.size - free


def pack(items: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS, length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to ``items``: each lies whole in one sequence of at most ``size``.

    Tasks get shares of about TASK_TOKENS tokens or TASK_PIECES items, dealt round robin, and take them
    longest first, so that the bins which close early are full. Deterministic for given rows: a task that
    runs again gives the same numbers. Lengths must be 1 to ``size``; others raise. No items give no rows.
    """
    items = spill(items)
    low, high, tokens, count = items.agg(F.min(length_col), F.max(length_col), F.sum(length_col), F.count("*")).first()
    if count and not (low is not None and 1 <= low and high <= size):
        raise ValueError(f"lengths must be 1 to {size}, found {low} to {high}")
    shares = max(1, -(-(tokens or 0) // TASK_TOKENS), -(-count // TASK_PIECES))
    plain = [c for c in items.columns if not items.schema[c].dataType.simpleString().startswith("map")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 40, BestFit(size, open_bins)
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column(length_col).to_pylist()], np.int64).reshape(-1, 2)
            extra = [pa.array(base + placed[:, 0], pa.int64()), pa.array(placed[:, 1], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "sequence_id", "offset"])

    ddl = keep_types(items, *items.columns) + ", sequence_id long, offset long"
    return (
        items.repartition(shares)
        .sortWithinPartitions(F.col(length_col).desc(), F.xxhash64(*plain), *plain)
        .mapInArrow(fill, ddl)
    )
