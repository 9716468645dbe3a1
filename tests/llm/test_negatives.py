"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, x int"


def brute(rows, positives=5, k=3, scale=256, every=50):
    ok = [(i, [math.floor(c * scale) for c in v], y) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q, y in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, z) for j, v, z in ok if len(v) == len(q))
        for p, j in [(-s, j) for s, j, z in scored if z == y and j != i][:positives]:
            fits = [(j2, -s) for s, j2, z in scored if z != y and 50 * p <= 100 * -s <= 95 * p][:k]
            out += [(i, j, r + 1, n, p, s) for r, (n, s) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, dim, steps):
    random.seed(seed)
    return [(i, [random.randint(-steps, steps) / steps for _ in range(dim)], random.choice([0, 0, 0, 1, 2]), "clash", 1) for i in range(n)]


ODD = [
    (None, [0.5, 0.5, 0.5], 1, None, 1), (50, None, 1, None, 1), (100, [0.5, None, 0.1], 1, None, 1), (150, [0.5, float("nan"), 0.1], 1, None, 1),
    (200, [0.5, float("inf"), 0.1], 0, None, 1), (250, [0.1, 0.2, 0.3], None, None, 1), (300, [0.4, 0.4], 0, None, 1), (301, [0.3, 0.4], 0, None, 1),
    (302, [0.3, 0.3], 1, None, 1), (350, [], 0, None, 1), (351, [], 0, None, 1), (352, [], 1, None, 1), (400, [0.0, 0.0, 0.0], 2, None, 1),
    (450, [0.9, 0.9, 0.9], 1, None, 1), (450, [0.9, 0.9, 0.9], 1, None, 1), (451, [0.9, 0.9, 0.8], 0, None, 1), (451, [0.9, 0.9, 0.8], 0, None, 1),
]


@pytest.mark.parametrize("seed,dim,steps,shard,block", [(1, 3, 3, 16, 2), (2, 3, 100, 4096, 256), (3, 8, 2, 7, 3)])
def test_mine(spark, seed, dim, steps, shard, block):
    rows = vectors(seed, 160, dim, steps) + [r for r in ODD if dim == 3]
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, shard=shard, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every=10)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("vec_id") % 50 == 0).collect() == []
    lone = spark.createDataFrame([(0, [1.0], 0, "", 1)], SCHEMA)
    assert negatives.mine(lone, F.col("vec_id") % 50 == 0).collect() == []
    named = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.75], "b"), (3, [0.5], "c")], "vec_id long, embedding array<float>, label string")
    assert [(r[1], r[2], r[3]) for r in negatives.mine(named, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 3)]


def test_large_components(spark):
    rows = [(0, [1e15, 1.0], 0, "", 1), (1, [1e15, 0.0], 0, "", 1), (2, [8e14, 3.0], 1, "", 1), (3, [8e14, 2.0], 1, "", 1), (4, [8e14, 4.0], 1, "", 1)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["negative_id"] for r in got] == []  # the positive's score is returned and compared as the nearest 64-bit number
    small = [(i, [c / 1e9 for c in v], y, s, x) for i, v, y, s, x in rows]
    got = negatives.mine(spark.createDataFrame(small, SCHEMA), F.col("vec_id") == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(small)


def test_search_stops_early_and_misses_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((500, 4)) * 50)
    x[:20, 0] += 3000  # a few rows far ahead in one list
    shard = negatives.Shard(np.arange(500), np.zeros(500, np.int64), x)
    q = np.array([9.0, -1.0, 0.0, 2.0])
    reads = []
    shard.lists = Counting(shard.lists, reads)
    scores = x @ q
    (ids, best), = shard.search(q, np.ones(500, bool), [(float("-inf"), float("inf"))], 5)
    assert ids.tolist() == sorted(range(500), key=lambda i: (-scores[i], i))[:5] and best.tolist() == sorted(scores, reverse=True)[:5]
    assert sum(reads) < 500  # of 1,500 entries
    fits = rng.random(500) < 0.5
    windows = [(100.0, 400.0), (-50.0, 0.0), (10**6, 10**7)]
    for (low, high), (ids, _) in zip(windows, shard.search(q, fits, windows, 3), strict=True):
        inside = [i for i in range(500) if fits[i] and low <= scores[i] <= high]
        assert ids.tolist() == sorted(inside, key=lambda i: (-scores[i], i))[:3]


class Counting:
    """Lists that note how many entries are read."""

    def __init__(self, lists, reads):
        self.lists, self.reads = lists, reads

    def __getitem__(self, key):
        out = self.lists[key]
        self.reads.append(out.size)
        return out
