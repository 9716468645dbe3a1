"""Removal of repeated passages by suffix sorting: external induced sorting over sampled suffixes.

A passage of ``length`` bytes is repeated if another suffix has the same first ``length`` bytes. Suffixes are
gathered by a sampled position: every window of ``length`` bytes has one anchor, the place of its least hashed
k-gram, so equal windows have equal anchors at equal offsets. Anchors whose k-gram occurs once settle all their
windows; where all surroundings of a k-gram are equal they settle them too. What remains, each distinct surrounding
once, is sorted in shards by k-gram: from the right end of a surrounding to its left, each suffix is induced from the
one after it. A disk-backed queue of one bucket per byte carries the tuples (suffix, common prefix with its
predecessor): popped in order, pushed by the byte before, so every level leaves sorted, with its common prefixes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import likely, slices, spill
from gapweave.llm.hashing import BYTE, mix, powers

GRAM = 32
#: Bytes looked at together when anchors are chosen.
BLOCK = 1 << 20
#: Bytes of tuples that a queue holds in memory.
MEMORY = 64 << 20
#: Distinct surroundings of one k-gram that one shard may sort; more are matched window by window.
HOT = 2_000
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        more = np.full(max(n, 1 << 12, 2 * len(_inverse)), _BASE_INVERSE, np.uint64)
        more[0] = 1
        _inverse = np.multiply.accumulate(more)
    return _inverse[:n]


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(len(data)))))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Rows (hash of the k-gram, hash of the surroundings, first window, windows, anchor - first window)."""
    gram = min(GRAM, length)
    out = [np.zeros((0, 5), np.uint64)]
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        sums, inverse = _prefix_sums(part), _inverse_powers(len(part))
        grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        low = np.uint64((1 << 22) - 1)
        places = (_sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        count = np.diff(np.append(first, len(places)))
        around = (sums[first + count - 1 + length] - sums[first]) * inverse[first]
        offset = places[first] - first
        around = mix(mix(around + count.astype(np.uint64)) ^ (offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out.append(np.stack([grams[places[first]], around, (first + at).astype(np.uint64), count.astype(np.uint64), offset.astype(np.uint64)], axis=1))
    return np.concatenate(out)


def alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, how many of them each row has): anchors of one text that differ only in their first window are one row."""
    order = np.lexsort(rows.T[[2, 4, 3, 1, 0]])
    rows = rows[order]
    rest = rows[:, [0, 1, 3, 4]]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(rows), 1), bool), (rest[1:] != rest[:-1]).any(axis=1))))
    return rows[new], rows[:, 2].astype(np.int64), np.diff(np.append(new, len(rows)))


class BucketQueue:
    """Monotone priority queue on disk: tuples pushed in rank order leave ordered by byte, then by rank.

    It carries common prefixes: what a tuple shares with the one before it in its bucket is one byte more
    than the least of the common prefixes of all tuples pushed between them.
    """

    DONE = 256

    def __init__(self, most: int, memory: int):
        self.most, self.memory, self.held = most, memory, 0
        self.buffers: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.extents: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        self.file = None
        self.begun = np.zeros(257, bool)
        self.least = np.full(257, np.iinfo(np.int32).max, np.int32)

    def push(self, symbols: np.ndarray, ids: np.ndarray, lcp: np.ndarray) -> None:
        n = len(ids)
        order = np.argsort(symbols, kind="stable")
        sym = symbols[order]
        edge = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1], [True])))
        new = np.zeros(n, np.int32)
        inner = np.ones(n, bool)
        inner[edge[:-1]] = False
        k = np.flatnonzero(inner)
        if len(k):
            spans = np.stack([order[k - 1] + 1, order[k] + 1], axis=1).ravel()
            new[k] = np.minimum.reduceat(np.append(lcp, np.iinfo(np.int32).max), spans)[::2]
        ahead, back = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
        present = sym[edge[:-1]]
        head, tail = order[edge[:-1]], order[edge[1:] - 1]
        new[edge[:-1]] = np.minimum(self.least[present], ahead[head])
        new = np.minimum(new + 1, self.most)
        fresh = ~self.begun[present]
        new[edge[:-1][fresh]] = 0
        self.least = np.minimum(self.least, ahead[-1])
        self.least[present] = np.where(tail + 1 < n, back[np.minimum(tail + 1, n - 1)], np.iinfo(np.int32).max)
        self.begun[present] = True
        tuples = np.stack([ids[order].astype(np.int32), new.astype(np.int32)], axis=1)
        for s, a, b in zip(present.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if s != self.DONE:
                self.buffers[s].append(tuples[a:b])
                self.held += (b - a) * 8
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # has no name, goes with the task
        for s, parts in enumerate(self.buffers):
            if parts:
                block = np.concatenate(parts)
                self.extents[s].append((self.file.seek(0, 2), len(block)))
                self.file.write(block.tobytes())
                self.buffers[s] = []
        self.held = 0

    def drain(self, rows: int = 1 << 18) -> Iterator[np.ndarray]:
        """Blocks of (suffix, common prefix with the one before), in order."""
        waiting: list[np.ndarray] = []
        size = 0
        for s in range(256):
            for place, n in self.extents[s]:
                for at in range(0, n, rows):
                    self.file.seek(place + 8 * at)
                    m = min(rows, n - at)
                    waiting.append(np.frombuffer(self.file.read(8 * m), np.int32).reshape(m, 2))
                    size += m
                    if size >= rows:
                        yield np.concatenate(waiting)
                        waiting, size = [], 0
            for part in self.buffers[s]:
                waiting.append(part)
                size += len(part)
                if size >= rows:
                    yield np.concatenate(waiting)
                    waiting, size = [], 0
            self.buffers[s] = []
        if waiting:
            yield np.concatenate(waiting)


def _room(shape: tuple[int, ...], kind: type, memory: int) -> np.ndarray:
    """Zeros, in memory or beyond ``memory`` bytes in a file without a name."""
    if int(np.prod(shape)) * np.dtype(kind).itemsize <= memory:
        return np.zeros(shape, kind)
    file = tempfile.TemporaryFile()
    file.truncate(int(np.prod(shape)) * np.dtype(kind).itemsize)
    return np.memmap(file, kind, "r+", shape=shape)


def repeated_windows(flat: np.ndarray, starts: np.ndarray, offsets: np.ndarray, counts: np.ndarray, length: int, memory: int = MEMORY) -> np.ndarray:
    """For surroundings that lie in ``flat`` from ``starts`` on, which of their windows have the same bytes
    as a window of another: a matrix, one row each, one column for each window.

    Level s holds the suffixes that begin ``length`` - 1 - s bytes after their anchors.
    """
    n, widest = len(starts), int(counts.max()) if len(counts) else 0
    marks = _room((n, widest), np.uint8, memory)
    if not n:
        return marks
    enter = offsets - counts + 1  # the level at which a surrounding's last byte is reached
    order = np.argsort(enter, kind="stable")
    bounds = np.searchsorted(enter[order], np.arange(int(enter.max()) + 2))
    now = BucketQueue(length, memory)
    for s in range(length + int(offsets.max()) + 1):
        after = BucketQueue(length, memory)
        base = length - 1 - s
        new = order[bounds[s] : bounds[s + 1]] if s + 1 < len(bounds) else order[:0]
        if len(new):
            after.push(flat[starts[new] + offsets[new] + base].astype(np.int16), new, np.zeros(len(new), np.int32))
        d = s - length  # offset of the windows that are complete
        before = None

        def mark(ids: np.ndarray) -> None:
            column = offsets[ids] - d
            fits = (column >= 0) & (column < counts[ids])
            marks[ids[fits], column[fits]] = 1

        for block in now.drain():
            ids, lcp = block[:, 0], block[:, 1]
            if d >= 0:
                same = lcp >= length
                if same.any():
                    hit = same.copy()
                    hit[:-1] |= same[1:]
                    mark(ids[hit])
                    if same[0] and before is not None:
                        mark(np.array([before]))
                before = ids[-1]
            place = offsets[ids] + base
            symbols = np.where(place >= 0, flat[starts[ids] + np.maximum(place, 0)].astype(np.int16), BucketQueue.DONE)
            after.push(symbols, ids, lcp)
        now = after
    return marks


def _ranges(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the runs of ones."""
    n = len(marks)
    side = np.zeros((n, 1), np.int8)
    edges = np.diff(np.concatenate((side, np.asarray(marks, np.int8), side), axis=1), axis=1)
    row, begin = np.nonzero(edges == 1)
    return row, begin, np.nonzero(edges == -1)[1]


def _shard(batches: Iterator[pa.RecordBatch], length: int, memory: int) -> Iterator[pa.RecordBatch]:
    """Sort one shard of surroundings and give the repeated windows of each."""
    file, size, meta, last = tempfile.TemporaryFile(), 0, [], None
    for batch in slices(batches, 4096):
        for h, r, off, count, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "r", "off", "windows", "raw")), strict=True):
            if (h, r) == last:
                continue  # the same surroundings, from a copy of the text
            last = (h, r)
            meta.append((h, r, off, count, size))
            file.write(raw)
            size += len(raw)
    if not meta:
        return
    file.flush()
    flat = np.memmap(file, np.uint8, "r", shape=(size,))
    if size <= memory:
        flat = np.array(flat)
    h, r, off, count, start = np.array(meta, np.int64).T
    row, begin, end = _ranges(repeated_windows(flat, start, off, count, length, memory))
    yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(r[row]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["h", "r", "a", "b"])


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def cut(raw: bytes, windows: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """(spans, kept bytes): the bytes that the windows cover, given as ranges of their starts, are taken out."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        b += length - 1
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return spans, b"".join([*kept, raw[at:]])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, r, parts): ranges that meet or overlap become one."""
    for batch in slices(batches, 4096):
        out = []
        for parts in batch.column("parts").to_pylist():
            runs: list[dict] = []
            for x in sorted(parts, key=lambda p: p["a"]):
                if runs and x["a"] <= runs[-1]["b"]:
                    runs[-1]["b"] = max(runs[-1]["b"], x["b"])
                else:
                    runs.append(x)
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("r"), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["h", "r", "parts"])


def dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """``docs`` with raw (the text as UTF-8), spans (start, end of each removed run, in bytes) and kept (the rest).

    Every byte goes that is covered by a string of ``length`` bytes which starts anywhere else too: in another
    row or the same, copies and repeated rows included; strings are judged on the input. A null text is an empty
    one and, like texts under ``length`` bytes, loses nothing. Ids are not used, other columns are carried along
    (columns named raw, spans or kept raise). No rows give no rows.
    """
    if clash := {"raw", "spans", "kept", "text_key", "windows"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    keyed = docs.withColumn("text_key", F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    texts = keyed.select("text_key", F.col(text_col).cast("string").alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [alike(anchors(np.frombuffer(_raw(t), np.uint8), length)) for t in batch.column(1).to_pylist()]
            rows = np.concatenate([x for x, _, _ in found])
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _, _ in found])))
            ends = np.cumsum(np.concatenate([[0], *(n for _, _, n in found)])).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x, _ in found])))
            plain = [*(pa.array(rows[:, k].view(np.int64)) for k in (0, 1)), keys, places, *(pa.array(rows[:, k].astype(np.int64)) for k in (3, 4))]
            yield pa.RecordBatch.from_arrays(plain, ["h", "r", "text_key", "places", "windows", "off"])

    sampled = texts.mapInArrow(sample, "h long, r long, text_key binary, places array<long>, windows long, off long")
    times = F.sum(F.size("places")).alias("n")
    seen = sampled.groupBy("h").agg(times, F.min("r").alias("low"), F.max("r").alias("high"))
    seen = seen.filter("n > 1").select("h", (F.col("low") != F.col("high")).alias("mixed"))
    repeated = spill(sampled.join(seen, "h"))

    mixed = repeated.filter("mixed")
    around = mixed.groupBy("h", "r").agg(times, F.min(F.struct("text_key", F.element_at("places", 1).alias("first"), "windows", "off")).alias("at"))
    around = spill(around.select("h", "r", "n", "at.*"))
    crowded = around.groupBy("h").agg((F.count("*") > hot).alias("hot"))
    asked = around.join(crowded, "h").groupBy("text_key").agg(F.collect_list(F.struct("h", "r", "first", "windows", "off", "hot")).alias("asked"))
    asked = spill(asked)
    # keys grow with the rows: they never go to the driver
    source = likely(texts, "text_key", asked.select("text_key")).join(asked, "text_key").select("text", "asked")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = _raw(text)
                for w in wants:
                    rows.append((w["h"], w["r"], w["off"], w["windows"], w["hot"], raw[w["first"] : w["first"] + w["windows"] + length - 1]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "r", "off", "windows", "hot", "raw"])

    raws = spill(source.mapInArrow(surroundings, "h long, r long, off long, windows long, hot boolean, raw binary"))
    ranges = "h long, r long, a int, b int"
    sorted_in = raws.filter("not hot").repartition("h").sortWithinPartitions("h", "r")
    partly = sorted_in.mapInArrow(lambda batches: _shard(batches, length, memory), ranges)

    # Surroundings of a k-gram that has very many: window by window, counted with partial sums.
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            for h, r, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "r", "raw")), strict=True):
                view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
                sums = _prefix_sums(np.frombuffer(raw, np.uint8))
                one = mix((sums[length:] - sums[:-length]) * _inverse_powers(len(view)))
                two = mix((view.astype(np.uint64) * mix(powers(length) + np.uint64(77))).sum(axis=1))
                n = len(view)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, h)), pa.array(np.full(n, r)), pa.array(np.arange(n, dtype=np.int32))], ["one", "two", "h", "r", "a"])

    if not raws.filter("hot").isEmpty():
        single = raws.filter("hot").dropDuplicates(["h", "r"]).mapInArrow(windows, "one long, two long, h long, r long, a int")
        twice = single.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two")
        partly = partly.union(single.join(twice, ["one", "two"]).select("h", "r", "a", (F.col("a") + 1).cast("int").alias("b")))

    # One row for each distinct surrounding: all its windows where it occurs more than once, else the runs found.
    listed = partly.groupBy("h", "r").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    listed = listed.mapInArrow(_merge, "h long, r long, parts array<struct<a:int,b:int>>")
    all_of = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").cast("int").alias("b")))
    runs = around.select("h", "r", "n", "windows").join(listed, ["h", "r"], "left")
    runs = spill(runs.select("h", "r", F.when(F.col("n") > 1, all_of).otherwise(F.col("parts")).alias("parts")).filter("parts is not null"))
    shifted = F.transform("places", lambda p: F.transform("parts", lambda x: F.struct((p + x["a"]).alias("a"), (p + x["b"]).alias("b"))))
    some = mixed.join(runs, ["h", "r"]).select("text_key", F.flatten(shifted).alias("parts"))
    whole = F.transform("places", lambda p: F.struct(p.alias("a"), (p + F.col("windows")).alias("b")))
    every = repeated.filter("not mixed").select("text_key", whole.alias("parts"))
    found = every.union(some).groupBy("text_key").agg(F.flatten(F.collect_set("parts")).alias("windows"))
    full = keyed.join(found, "text_key", "left").drop("text_key")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            raw = [_raw(t) for t in batch.column(names.index(text_col)).cast(pa.string()).to_pylist()]
            done = [cut(x, [(w["a"], w["b"]) for w in ws or ()], length) for x, ws in zip(raw, batch.column(names.index("windows")).to_pylist(), strict=True)]
            spans = pa.array([[{"a": a, "b": b} for a, b in d[0]] for d in done], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            at = [k for k, x in enumerate(names) if x != "windows"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), pa.array(raw, pa.binary()), spans, pa.array([d[1] for d in done], pa.binary())], [*(names[k] for k in at), "raw", "spans", "kept"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return full.mapInArrow(remove, f"{ddl}, raw binary, spans array<struct<a:long,b:long>>, kept binary")
