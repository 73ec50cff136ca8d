"""Operator 12, against a direct computation, and its law of growth."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from lectern.llm.sharding import read_shards, rendezvous, write_shards
from pyspark.sql import functions as F


def shard_of(key, weights):
    def time(k, w):
        drawn = int(hashlib.md5(f"{'' if key is None else key}/{k}".encode()).hexdigest()[:13], 16)
        return -math.log((drawn + 0.5) / 2**52) / w

    return min((time(k, w), k) for k, w in enumerate(weights) if w > 0)[1]


@pytest.mark.parametrize("weights", [(1.0,) * 16, (1, 2, 0, 5), (3,)])
@pytest.mark.parametrize("table", ["small", "edges", "nothing"])
def test_shards(request, spark, table, weights):
    docs = request.getfixturevalue(table)
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("slot", F.lit("x")).withColumn("shard", F.lit(-1))
    path = write_shards(docs, weights=weights)
    got = read_shards(spark, path).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        assert r.shard == shard_of(r.doc_id, weights)
        slots[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
    for found in slots.values():
        assert [s for s, _ in sorted(found)] == [*range(len(found))]
        assert [d for _, d in sorted(found)] == sorted(d for _, d in found)
    one = read_shards(spark, path, [0]).collect()
    assert sorted(r.slot for r in one) == sorted(r.slot for r in got if r.shard == 0)


def test_growth_and_weights(spark):
    keys = spark.range(20_000).select(rendezvous(F.col("id"), [1.0] * 8).alias("a"), rendezvous(F.col("id"), [1.0] * 9).alias("b"), rendezvous(F.col("id"), [1, 1, 2, 4]).alias("c"), rendezvous(F.col("id"), [1, 1, 2, 5]).alias("d"))
    rows = keys.collect()
    moved = [r for r in rows if r.a != r.b]
    assert all(r.b == 8 for r in moved) and abs(len(moved) - 20_000 / 9) < 300
    sizes = Counter(r.c for r in rows)
    assert all(abs(sizes[k] - 20_000 * w / 8) < 400 for k, w in enumerate([1, 1, 2, 4]))
    assert all(r.d == 3 for r in rows if r.c != r.d)


def test_weights_are_checked():
    for weights in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            rendezvous(F.lit("x"), weights)


def test_one_key_of_most_rows(spark):
    """Rows of one key are of one shard, but of many parts; slots stay gapless."""
    docs = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "'t' AS text")
    rows = read_shards(spark, write_shards(docs)).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.countDistinct("slot").alias("d")).collect()
    assert all(r.a == 0 and r.z == r.n - 1 and r.d == r.n for r in rows) and sum(r.n for r in rows) == 30_000
