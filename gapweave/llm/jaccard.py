"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams (by hash) is cut into fragments, and a document's set into the segments that fall
there. Each fragment is counted on its own: which of a set's n-grams also occur in another set. Fragments report to
buckets of sets, in packed arrays; the partial counts are summed per set there, and a set that shares too few n-grams
with all others together is out. The rest are candidates of each other by their rarest shared n-grams: of two
similar sets, the rarest common n-gram is among the first few of both, so common n-grams alone never make candidates. Candidates that hang together are compared exactly: n-grams
are counted fragment by fragment, for all pairs of a block at once, and the partial overlaps are summed per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import keep_types, likely, slices, spill
from gapweave.llm.components import components
from gapweave.llm.hashing import mix, shingles

#: Documents of one side of a compared block, and n-grams counted at once there.
BLOCK = 256
FRAGMENT = 4096
#: N-grams (4 bytes each) of one fragment, and how many fragments there are at least.
HELD = 4_000_000
LEAST_PARTS = 64


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # bytes: A-Z only


def set_key(x: np.ndarray) -> int | None:
    """64 bits that stand for a set; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) if len(x) else None


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: partial counts by fragment, summed."""
    total = np.zeros((len(a), len(b)), np.int64)
    flat = [np.concatenate(z) for z in (a, b)]
    both = np.intersect1d(*(np.unique(z) for z in flat), assume_unique=True)
    rows = [np.repeat(np.arange(len(z)), [len(x) for x in z]) for z in (a, b)]
    if not len(both):
        return total
    at = [np.minimum(np.searchsorted(both, z), len(both) - 1) for z in flat]
    kept = [both[k] == z for k, z in zip(at, flat, strict=True)]
    at, rows = [k[m] for k, m in zip(at, kept, strict=True)], [r[m] for r, m in zip(rows, kept, strict=True)]
    order = [np.argsort(k, kind="stable") for k in at]
    at, rows = [k[o] for k, o in zip(at, order, strict=True)], [r[o] for r, o in zip(rows, order, strict=True)]
    for low in range(0, len(both), FRAGMENT):
        high = min(low + FRAGMENT, len(both))
        part = []
        for k, r, n in zip(at, rows, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(k, (low, high))
            m = np.zeros((n, high - low), np.float32)
            m[r[i:j], k[i:j] - low] = 1
            part.append(m)
        total += (part[0] @ part[1].T).astype(np.int64)
    return total


def _links(keys: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Edges that join what is linked in a block: each set to the smallest key it reaches there."""
    ia, ib = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    if not len(ia) or not len(ib):
        return []
    both = overlaps([sets[k] for k in ia], [sets[k] for k in ib])
    size = np.array([len(x) for x in sets])
    hit = q * both >= p * (size[ia][:, None] + size[ib][None, :] - both)
    low = keys.copy()
    while True:
        new = low.copy()
        far = np.iinfo(np.int64).max
        new[ia] = np.minimum(new[ia], np.where(hit, low[ib][None, :], far).min(axis=1))
        new[ib] = np.minimum(new[ib], np.where(hit, new[ia][:, None], far).min(axis=0))
        if (new == low).all():
            break
        low = new
    return [(int(k), int(m)) for k, m in zip(keys, low, strict=True) if k != m]


def _compare(blocks: DataFrame, texts: DataFrame, n: int, least: Fraction) -> DataFrame:
    """(u, v): links found in blocks given as (cluster, i, j, side, k); side 2 stands on both sides."""
    p, q = least.numerator, least.denominator
    keys = ["cluster", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        now = None

        def close() -> pa.RecordBatch:
            k, side = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held])
            found = _links(k, side, [shingles(h[2], n) for h in held], p, q)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

        for batch in slices(batches):
            for r in batch.to_pylist():
                key = (r["cluster"], r["i"], r["j"])
                if key != now and held:
                    yield close()
                    held = []
                now = key
                held.append((r["k"], r["side"], r["raw"]))
        if held:
            yield close()

    full = blocks.join(texts, "k").select(*keys, "side", "k", "raw")
    return full.repartition(*keys).sortWithinPartitions(*keys, "side", "k").mapInArrow(run, "u long, v long")


def described(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """The id, n_shingles and k (key of the set) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(_raw(t), n) for t in batch.column(1).to_pylist()]
            size, key = pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, key], ["id", "n_shingles", "k"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, keep_types(source, "id") + ", n_shingles long, k long")


def segments(docs: DataFrame, n: int, fragments: int, text_col: str) -> DataFrame:
    """(fragment, ks, wholes, sizes, grams): the segments of some sets in one fragment, as packed arrays.

    A segment carries the size of its whole set. An n-gram is 32 bits of its hash there; two that agree count as one,
    which can only add candidates. Of equal sets in one task, one is sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets: dict[int, np.ndarray] = {}
            for text in batch.column(0).to_pylist():
                x = shingles(_raw(text), n)
                k = set_key(x)
                if k is not None and k not in seen:
                    seen.add(k)
                    sets[k] = x
            if not sets:
                continue
            keys, flat = np.array(list(sets), np.int64), np.concatenate(list(sets.values()))
            whole = np.array([len(x) for x in sets.values()], np.uint32)
            owner = np.repeat(np.arange(len(keys)), whole)
            place = ((flat >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            order = np.argsort(place, kind="stable")
            flat, owner, place = flat[order], owner[order], place[order]
            cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
            out = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                at, size = np.unique(owner[i:j], return_counts=True)
                out.append((int(place[i]), keys[at].tobytes(), whole[at].tobytes(), size.astype(np.uint32).tobytes(), flat[i:j].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)],
                ["fragment", "ks", "wholes", "sizes", "grams"],
            )

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "fragment int, ks binary, wholes binary, sizes binary, grams binary")


def shared_grams(keys: np.ndarray, wholes: np.ndarray, sizes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, ...]:
    """What each set of a fragment shares with any other: keys, sizes of the sets, numbers shared, and the shared n-grams
    of one set after the other with the number of sets they are in (at most 255)."""
    keys, first = np.unique(keys, return_index=True)  # a set may come from several tasks
    sizes = sizes.astype(np.int64)
    taken, size, whole = (np.cumsum(sizes) - sizes)[first], sizes[first], wholes[first]
    owner = np.repeat(np.arange(len(keys), dtype=np.uint64), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(taken, size)
    pairs = np.sort(grams[at].astype(np.uint64) << np.uint64(32) | owner)
    gram = pairs >> np.uint64(32)
    start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    other = np.concatenate(([True], pairs[1:] != pairs[:-1]))
    count = np.repeat(np.add.reduceat(other.astype(np.int64), start), np.diff(np.append(start, len(pairs)))) if len(pairs) else np.zeros(0, np.int64)
    pairs, count = pairs[count > 1], np.minimum(count[count > 1], 255).astype(np.uint8)
    owner = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    owner, gram, count = owner[order], (pairs[order] >> np.uint64(32)).astype(np.uint32), count[order]
    some, number = np.unique(owner, return_counts=True)
    return keys[some], whole[some], number.astype(np.uint32), gram, count


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _by(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows of sorted batches, by value of a column: (value, lists of the other columns)."""
    now, held = None, {}
    for batch in slices(batches):
        for r in batch.to_pylist():
            if r[column] != now:
                if held:
                    yield now, held
                now, held = r[column], {}
            for name, value in r.items():
                held.setdefault(name, []).append(value)
    if held:
        yield now, held


def _joined(held: dict[str, list], *names: str) -> list[np.ndarray]:
    kinds = {"ks": np.int64, "counts": np.uint8}
    return [np.frombuffer(b"".join(held[n]), kinds.get(n, np.uint32)) for n in names]


def _shared(parts: DataFrame, fragments: int, buckets: int) -> DataFrame:
    """(bucket, fragment, ks, wholes, sizes, grams, counts): what the sets of a bucket share with others in a fragment."""
    names = ["bucket", "fragment", "ks", "wholes", "sizes", "grams", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, held in _by(batches, "fragment"):
            keys, whole, number, gram, count = shared_grams(*_joined(held, "ks", "wholes", "sizes", "grams"))
            bucket = _bucket(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            begin = (np.cumsum(number) - number)[order]
            size = number[order].astype(np.int64)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin.astype(np.int64), size)
            keys, whole, number, gram, count, bucket = keys[order], whole[order], number[order], gram[at], count[at], bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else []
            place = np.concatenate(([0], np.cumsum(size)))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                p, q = place[i], place[j]
                packed = [x.tobytes() for x in (keys[i:j], whole[i:j], number[i:j], gram[p:q], count[p:q])]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i])], pa.int32()), pa.array([fragment], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names)

    dealt = parts.repartition(fragments, "fragment").sortWithinPartitions("fragment")
    return dealt.mapInArrow(run, "bucket int, fragment int, ks binary, wholes binary, sizes binary, grams binary, counts binary")


def rarest(held: dict[str, list], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, key) for the sets of a bucket that share enough to be similar to another: the first of each set's
    shared n-grams, rare ones first, so many that a similar set has one of them too."""
    ks, wholes, sizes, grams, counts = _joined(held, "ks", "wholes", "sizes", "grams", "counts")
    high = np.repeat(np.array(held["fragment"], np.uint64), [len(x) // 4 for x in held["grams"]])
    keys, first, of = np.unique(ks, return_index=True, return_inverse=True)
    whole, shared = wholes[first].astype(np.int64), np.bincount(of, sizes, len(keys)).astype(np.int64)
    needed = -(-least.numerator * whole // least.denominator)  # a similar set has so many of them
    owner = np.repeat(of, sizes)
    fits = (shared >= needed)[owner]
    owner, gram, count = owner[fits], (high << np.uint64(32) | grams)[fits], counts[fits]
    order = np.lexsort((gram, count, owner))
    owner, gram = owner[order], gram[order]
    begin = np.searchsorted(owner, np.arange(len(keys)))
    taken = np.arange(len(owner)) - begin[owner] < (shared - needed + 1)[owner]
    rows = np.unique(np.stack([gram[taken].view(np.int64), keys[owner[taken]]], axis=1), axis=0)
    return rows[:, 0], rows[:, 1]


def signatures(docs: DataFrame, rows: DataFrame, n: int, least: Fraction, text_col: str) -> DataFrame:
    """(s, k): the rarest shared n-grams of the sets that share enough to be similar to any other.

    Fragments, and buckets of sets to which they report, are as many as memory needs and 64 at least.
    """
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // HELD))
    found = _shared(segments(docs, n, parts, text_col), parts, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by(batches, "bucket"):
            s, k = rarest(held, least)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k)], ["s", "k"])

    return found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "s long, k long")


def _texts(docs: DataFrame, wanted: DataFrame, n: int, text_col: str) -> DataFrame:
    """(k, raw): one lower-cased text for each wanted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [_raw(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(shingles(x, n)) for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["k", "raw"])

    keyed = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k long, raw binary")
    one = likely(keyed, "k", wanted).groupBy("k").agg(F.first("raw").alias("raw"))
    return one.join(wanted.hint("merge"), "k", "left_semi")  # keys grow with the rows: they never go to the driver


def join(docs: DataFrame, n: int = 3, least: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles, component_id and class_id (the smallest id with the same set) per row.

    Sets hold the distinct runs of ``n`` words (lower-case A-Z; words end at bytes 9 to 13 and 32), or the whole
    sequence if it is shorter. Sets link when |A and B| >= least * |A or B|. Rows without words or text have an
    empty set (n_shingles 0) and link with nothing; rows of equal sets are one class, repeated rows included. A
    null id is carried along, and is never the smallest. Other columns are not read; no rows give none.
    Sets are compared by 64-bit hashes of their n-grams.
    """
    rows = spill(described(docs, n, id_col, text_col))
    signed = spill(signatures(docs, rows, n, least, text_col))
    shared = signed.groupBy("s").agg(F.min("k").alias("hub"), F.max("k").alias("last")).filter("hub <> last").select("s", "hub")
    # a merge join at every size: a hot n-gram is split by Spark, and cost grows in proportion
    touching = spill(signed.join(shared.hint("merge"), "s").filter("k <> hub").select("k", "hub").distinct())
    clusters = components(touching, "k", "hub").select(F.col("node").alias("k"), F.col("root").alias("cluster"))
    clusters = spill(clusters)
    texts = spill(_texts(docs, clusters.select("k"), n, text_col))

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    member = clusters.join(sizes, "cluster").withColumn("chunks", F.ceil(F.col("m") / BLOCK).cast("int"))
    member = member.withColumn("chunk", F.pmod(F.xxhash64("k", F.lit(8)), F.col("chunks")).cast("int"))
    member = spill(member)
    zero = F.lit(0)
    own = member.select("cluster", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.lit(2).alias("side"), "k")
    many = member.filter("chunks > 1")
    star = many.filter("chunk > 0").select("cluster", zero.alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side"), "k")
    first = many.filter("chunk = 0").select("cluster", zero.alias("i"), F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)).alias("j"), zero.alias("side"), "k")
    links = spill(_compare(own.union(star).union(first), texts, n, least))

    # In clusters of more than one block: what the first round left outside the largest part meets everything.
    roots = components(links, "u", "v").select(F.col("node").alias("k"), "root")
    placed = many.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    parts = placed.groupBy("cluster", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    left = spill(placed.join(main, "cluster").filter("root <> main").select("cluster", "k", "chunks"))
    counted = left.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    if not counted.isEmpty():
        left = left.join(counted, "cluster").withColumn("g", F.pmod(F.xxhash64("k", F.lit(9)), F.col("groups")).cast("int"))
        rest = left.select("cluster", F.col("g").alias("i"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("j"), zero.alias("side"), "k")
        all_of = many.join(counted, "cluster").select("cluster", F.explode(F.sequence(zero, F.col("groups") - 1)).alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side"), "k")
        links = links.union(_compare(rest.union(all_of), texts, n, least))
        roots = components(links, "u", "v").select(F.col("node").alias("k"), "root")

    known = rows.select("id", "n_shingles", "k").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least_id = known.filter("k is not null").groupBy("root").agg(F.min("id").alias("component"))
    class_id = known.filter("k is not null").groupBy("k").agg(F.min("id").alias("class"))
    out = known.join(least_id, "root", "left").join(class_id, "k", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce("class", "id").alias("class_id"))
