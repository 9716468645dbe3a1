"""Language-model scores by a class-based bigram model with exchange clustering.

Words are counted over all training texts. The most frequent words are units of their own; all others form units
by their ending. Exchange clustering moves units between classes as long as the likelihood of the class bigrams
grows, from unit bigrams counted over all training texts. A text's probability is the product of
P(class | class before) and P(word | class), both smoothed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import keep_types, slices, spill

#: Units: words with a unit of their own, endings of the others, classes.
WORDS, ENDINGS, CLASSES = 2_048, 64, 64
#: Word counts that every task holds; those of all other words are joined.
BROADCAST_WORDS = 200_000
#: Weight of the class frequencies in class transitions.
BACKOFF = 20.0
SWEEPS = 6
_TAIL = 3


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; they end at bytes 9 to 13 and 32."""
    return (text or "").encode("utf-8", "replace").lower().split()


def ending(word: bytes) -> int:
    return crc32(word[-_TAIL:]) % ENDINGS


@dataclass
class Model:
    """Units are own words, then endings, then the end of a text."""

    frequent: dict[bytes, tuple[int, int]]  #: word -> (unit, count)
    classes: np.ndarray  #: class of each unit
    step: np.ndarray  #: log10 P(class | class before)
    room: np.ndarray  #: log10 of each class's emission denominator
    ends: int  #: count of the end token
    tokens: int
    distinct: int
    counts: DataFrame | None = None  #: (w, c) of all training words


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(w, c): occurrences of every word; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "c"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
            if len(held) > most:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


class _Units(dict):
    """Word -> unit, by its ending for words that are not listed."""

    def __missing__(self, word: bytes) -> int:
        return WORDS + ending(word)


def unit_bigrams(texts: DataFrame, units: dict[bytes, int]) -> np.ndarray:
    """Counts of neighbouring units, the end of a text included on both sides. Tasks send counted pairs by
    blocks of rows; blocks are added up on executors, in two rounds with salted keys, and a matrix of bounded size reaches the driver."""
    size, rows, salts = WORDS + ENDINGS + 1, 64, 64

    def packed(block: int, salt: int, part: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(part)
        columns = [pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "salt", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, held, waiting = _Units(units), np.zeros(size * size, np.int64), [], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seq = np.array([size - 1, *map(known.__getitem__, tokens(text)), size - 1], np.int64)
                held.append(seq[:-1] * size + seq[1:])
                waiting += len(seq)
            if waiting > 2_000_000:
                total += np.bincount(np.concatenate(held), minlength=size * size)
                held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size * size)
        for block in range(-(-size // rows)):
            yield packed(block, TaskContext.get().partitionId() % salts, total[block * rows * size : (block + 1) * rows * size])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(rows * size, np.int64)
        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if now is not None and now != (r["block"], r["salt"]):
                    yield packed(*now, total)
                    total[:] = 0
                now = (r["block"], r["salt"])
                total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.int64)
        if now is not None:
            yield packed(*now, total)

    def added(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, kinds)

    kinds = "block int, salt int, at binary, n binary"
    out = np.zeros((-(-size // rows)) * rows * size, np.int64)
    for r in added(added(texts.mapInArrow(count, kinds), "block", "salt").withColumn("salt", F.lit(0)), "block", "salt").collect():
        out[r["block"] * rows * size + np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out[: size * size].reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, k: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit. The last unit keeps a class of its own, number ``k``.

    A unit leaves its class and joins the one with the highest class-bigram likelihood, most frequent units
    first, until a sweep moves none or ``sweeps`` are done. Units that do not occur stay in class 0.
    """
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(axis=1)
    order = [u for u in np.argsort(-weight[:-1], kind="stable") if weight[u]]
    classes = np.zeros(n, np.int64)
    classes[order] = np.arange(len(order)) % k
    classes[-1] = k
    member = np.zeros((n, k + 1))
    member[np.arange(n), classes] = 1
    after, before = pairs @ member, pairs.T @ member  # unit x class
    both = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old, own = classes[u], pairs[u, u]
            o, i = after[u].copy(), before[u].copy()
            o[old] -= own
            i[old] -= own
            both[old, :] -= o
            both[:, old] -= i
            both[old, old] -= own
            left, right = both.sum(axis=1), both.sum(axis=0)
            # what joining class c adds: its row, its column, the cell where they meet, and both margins
            grown = _xlogx(both + o[None, :]) - _xlogx(both)
            turned = _xlogx(both + i[:, None]) - _xlogx(both)
            cell = np.diag(both)
            meet = _xlogx(cell + o + i + own) - _xlogx(cell) - np.diag(grown) - np.diag(turned)
            total_o, total_i = o.sum() + own, i.sum() + own
            margins = _xlogx(left + total_o) - _xlogx(left) + _xlogx(right + total_i) - _xlogx(right)
            gain = grown.sum(axis=1) + turned.sum(axis=0) + meet - margins
            new = int(np.argmax(gain[:k]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            both[new, :] += o
            both[:, new] += i
            both[new, new] += own
            if new != old:
                moved += 1
                classes[u] = new
                after[:, old] -= pairs[:, u]
                after[:, new] += pairs[:, u]
                before[:, old] -= pairs[u, :]
                before[:, new] += pairs[u, :]
        if not moved:
            break
    return classes


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all words and unit bigrams of ``docs`` and cluster. Null texts are empty ones: an end token each."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = spill(word_counts(texts))
    ends = docs.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_count = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = 1 << 62, BROADCAST_WORDS
    for c, n in by_count:
        if n > room:
            break
        least, room = c, room - n
    listed = sorted(((r["c"], bytes(r["w"])) for r in counts.filter(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    own = {w: k for k, (_, w) in enumerate(listed[:WORDS])}
    pairs = unit_bigrams(texts, own)
    classes = exchange(pairs)

    by_ending = counts.groupBy((F.crc32(F.expr(f"substring(w, -{_TAIL}, {_TAIL})")) % ENDINGS).alias("e")).agg(F.count("*").alias("n"))
    kinds = np.zeros(len(classes))
    kinds[: len(own)] = 1
    for r in by_ending.collect():
        kinds[WORDS + r["e"]] += r["n"]
    for w in own:
        kinds[WORDS + ending(w)] -= 1
    k = CLASSES + 1
    member = np.zeros((len(classes), k))
    member[np.arange(len(classes)), classes] = 1
    seen = member.T @ pairs @ member
    size, varied = seen.sum(axis=0), member.T @ kinds
    share = (size + 1) / (size.sum() + k)
    step = np.log10((seen + BACKOFF * share[None, :]) / (seen.sum(axis=1, keepdims=True) + BACKOFF))
    room_of = np.log10(size + varied + 1)
    room_of[-1] = 0.0
    frequent = {w: (own.get(w, WORDS + ending(w)), c) for c, w in listed}
    return Model(frequent, classes, step, room_of, ends, total + ends, distinct + (ends > 0), counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, n_known, base (sum of log10 (c + 1)) and score per row.

    A null or empty text is one end token; a null id stays null; repeated rows are scored one by one; words that
    training has not seen take the class of their ending. Words outside the broadcast list get their counts by a
    join on (row, word), so that no task needs the whole vocabulary.
    """
    counts = model.counts
    classes, step, room, ends = model.classes, model.step, model.room, model.ends
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent)
    end = len(classes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                found = list(map(known.get, words))
                rare = Counter(w for w, f in zip(words, found, strict=True) if f is None)
                units = np.array([WORDS + ending(w) if f is None else f[0] for w, f in zip(words, found, strict=True)], np.int64)
                seen = np.array([f[1] for f in found if f is not None], np.float64)
                path = classes[np.concatenate(([end], units, [end]))]
                moves = step[path[:-1], path[1:]].sum() - room[path[1:]].sum()
                log = np.log10(seen + 1).sum() + np.log10(ends + 1)
                out.append((len(words) + 1, len(seen) + (ends > 0), log, moves + log - np.log10(ends + 1), list(rare), list(rare.values())))
            n, k, log, s, rare, times = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([int(x) for x in k], pa.int64()), pa.array(log, pa.float64()), pa.array(s, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["id", "n_tokens", "n_known", "log", "s", "rare", "times"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = keep_types(source, "id") + ", n_tokens long, n_known long, log double, s double, rare array<binary>, times array<long>"
    part = spill(source.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()))
    words = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("t"))
    more = words.join(counts, "w").groupBy("row").agg(F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("more"), F.sum("t").alias("known"))
    full = part.drop("rare", "times").join(more, "row", "left")
    gained, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return full.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + seen).alias("n_known"), (F.col("log") + gained).alias("base"), (F.col("s") + gained).alias("score")
    )
