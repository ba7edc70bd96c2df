import random

import pytest
from pyspark.sql import functions as F

from keystrata.llm.sharding import LOWEST, shard_by_bytes, splitters


def check(rows, shards):
    assert all(0 <= r.shard < shards for r in rows)
    for k in range(shards):
        own = sorted((r for r in rows if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [LOWEST if r.key is None else r.key for r in own]
        assert keys == sorted(keys)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.key is None for r in order] == sorted((r.key is None for r in order), reverse=True)
    return [sum(r.size for r in rows if r.shard == k) for k in range(shards)]


@pytest.mark.parametrize("keys", ["dense", "sparse", "wide"])
@pytest.mark.parametrize("ranges", [1, 3])
def test_bytes_are_near_equal(spark, keys, ranges):
    rng = random.Random(2)
    make = {"dense": lambda i: i, "sparse": lambda i: rng.randint(-(10**12), 10**12), "wide": lambda i: rng.choice([-1, 1]) * rng.randint(0, (1 << 63) - 2)}[keys]
    data = list({make(i): rng.choice([1, 5, 300]) for i in range(700)}.items())
    df = spark.createDataFrame(data, "key long, size long").withColumn("slot", F.lit("clash"))
    out = shard_by_bytes(df, "key", "size", 7, ranges, probes=8)
    total = check(out.collect(), 7)
    assert sum(total) == sum(s for _, s in data) and out.count() == len(data)
    assert max(total) - min(total) <= 2 * 300


def test_splitters_are_exact(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    assert splitters(rows, 4, probes=5)[0] == [250, 500, 750]
    assert splitters(rows, 4, probes=5, tolerance=40)[1] < splitters(rows, 4, probes=5)[1]


def test_hot_and_odd_keys(spark):
    same = spark.createDataFrame([(5, 1)] * 50 + [(9, 1)] * 10, "key long, size long")
    assert sorted(check(shard_by_bytes(same, "key", "size", 4).collect(), 4)) == [0, 0, 10, 50]  # equal keys stay together
    odd = spark.createDataFrame([(None, 3), (None, None), (1, 2), (-7, 1)], "key long, size long")
    rows = shard_by_bytes(odd, "key", "size", 2).withColumn("size", F.coalesce("size", F.lit(0))).collect()
    assert sum(check(rows, 2)) == 6 and len(rows) == 4
    assert shard_by_bytes(odd.where("key > 99"), "key", "size", 2).count() == 0
    assert check(shard_by_bytes(odd.where("key = 1"), "key", "size", 16).collect(), 16).count(2) == 1


def test_registered_query_against_brute_force(spark):
    """Every column of op9, from the texts: a row lies right of a splitter if half of its own bytes do."""
    import zlib

    from keystrata.llm.queries import op9_sharding

    from ..conftest import SF

    docs = sorted(((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    total, below, want, slots = sum(len(t) + 1 for _, t in docs), 0, [], [0] * 16
    for i, t in docs:
        size = len(t) + 1
        shard = sum(2 * (total * j // 16) <= 2 * below + size for j in range(1, 16))
        want.append((i, size, zlib.crc32(t), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        below += size
    out = op9_sharding(spark, SF)
    assert sorted(map(tuple, out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect())) == want
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan


def test_no_python_in_the_plan(spark):
    df = spark.range(100).select(F.col("id").alias("key"), F.lit(1).alias("size"))
    plan = shard_by_bytes(df, "key", "size", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
