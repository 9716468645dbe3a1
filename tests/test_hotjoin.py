"""Split joins on uneven keys."""

import random
from collections import Counter as Exact

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapweave.operators import clean, hotjoin


def test_counter_keeps_every_frequent_value():
    random.seed(0)
    values = [random.choice("abc") if random.random() < 0.6 else str(random.randint(0, 5000)) for _ in range(20_000)]
    counter = hotjoin.Counter(50)
    for at in range(0, len(values), 997):
        counter.add(pa.array([*values[at : at + 997], None]))
        assert len(counter.counts) <= 50
    exact = Exact(values)
    assert counter.seen == len(values)
    for v, n in exact.items():
        got = counter.counts.get(v, 0)
        assert n - len(values) / 50 <= got <= n


@pytest.fixture(scope="module")
def uneven(spark):
    return spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 1000 == 7, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 3000).cast("string"))).alias("key")).repartition(6)


@pytest.mark.parametrize("share", [0.01, 0.9])
def test_lookup_is_a_left_join(spark, uneven, share):
    words = uneven.select("key").distinct().filter("key IS NOT NULL AND key <> 'k9'").withColumn("v", F.length("key")).withColumn("w", F.upper("key"))
    got = hotjoin.lookup(uneven, words, "key", "key", share)
    want = uneven.join(words, "key", "left").select("id", "key", "v", "w")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 30_000


def test_frequent_keys_do_not_move(spark, uneven):
    words = uneven.select("key").distinct().filter("key IS NOT NULL").withColumn("v", F.length("key"))
    assert {r["key"] for r in hotjoin.frequent(uneven, "key", 0.01).collect()} == {"hot"}
    plan = hotjoin.lookup(uneven, words, "key", "key", 0.01)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    far = uneven.filter("key <> 'hot'").repartition(8, "key").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert far.max() < 3 * far.median()  # what is still shuffled by key is even


def test_edges(spark, uneven):
    words = spark.createDataFrame([("hot", 1)], "key string, v int")
    none = uneven.limit(0)
    assert hotjoin.lookup(none, words, "key", "key").collect() == []
    assert hotjoin.lookup(uneven, words.limit(0), "key", "key").filter("v IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        hotjoin.lookup(uneven.withColumn("v", F.lit(1)), words, "key", "key")


def test_labels_with_a_large_dictionary(uneven, monkeypatch):
    small = clean.label_codes(uneven, ["key"])
    large = clean.LabelCodes(small.codes, False)
    a, b = (x.encode(uneven, "key", "code", keep=True).select("id", "key", "code") for x in (small, large))
    assert a.exceptAll(b).count() == 0 and b.count() == 30_000
    back = large.decode(b, "code", "key", "label")
    assert back.filter("NOT (key <=> label)").count() == 0 and back.count() == 30_000
