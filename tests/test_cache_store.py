"""A cache in buckets, against a dictionary."""

import random
from pathlib import Path

from lectern.sources.cache_store import CacheStore

SCHEMA = "key string, bytes long, created_at long, last_used long, model string"


class Plain:
    def __init__(self, budget):
        self.rows, self.budget, self.pending = {}, budget, 0

    def put(self, rows):
        """The last point of a call at which the budget is looked at."""
        looked = (self.pending + len(rows)) // 25 * 25 - self.pending
        self.pending = (self.pending + len(rows)) % 25
        for k, r in enumerate(rows, 1):
            self.rows[r[0]] = r
            if k == looked:
                total = sum(x[1] for x in self.rows.values())
                for x in sorted(self.rows.values(), key=lambda x: (x[3], x[0])):
                    if total <= self.budget:
                        break
                    del self.rows[x[0]]
                    total -= x[1]


def files(path):
    return {p.parent.name: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_like_a_dictionary(spark, tmp_path):
    draw, at = random.Random(5), 0
    store, plain = CacheStore(spark, f"{tmp_path}/cache", SCHEMA, budget=3000, buckets=8), Plain(3000)
    assert store.read().count() == 0
    for n in (10, 20, 3, 60, 1):
        rows = []
        for _ in range(n):
            at += 1
            rows.append((f"k{draw.randint(0, 70)}", draw.randint(20, 120), at, at, draw.choice(["pro", None])))
        store.put(spark.createDataFrame(rows, SCHEMA).repartition(3), ["created_at"])
        plain.put(rows)
        assert sorted(map(tuple, store.read().collect())) == sorted(plain.rows.values())
    assert len(plain.rows) < 71 and sum(r[1] for r in plain.rows.values()) < 4000


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/cache"
    store = CacheStore(spark, path, SCHEMA, buckets=8)
    store.put(spark.createDataFrame([(f"k{i}", 1, i, i, "m") for i in range(40)], SCHEMA), ["created_at"])
    before = files(path)
    store.put(spark.createDataFrame([("k3", 5, 100, 100, "m"), (None, 9, 101, 101, "m")], SCHEMA), ["created_at"])
    after = files(path)
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    store.touch(spark.createDataFrame([("k3", 500), ("k3", 400), ("other", 9)], "key string, at long"))
    got = {r.key: r for r in store.read().collect()}
    assert len(got) == 40 and (got["k3"].bytes, got["k3"].last_used, got["k4"].last_used) == (5, 500, 4)


def test_clear_and_nothing(spark, tmp_path):
    store = CacheStore(spark, f"{tmp_path}/cache", SCHEMA, budget=10)
    store.clear()
    store.put(spark.createDataFrame([], SCHEMA), ["created_at"])
    assert store.read().count() == 0
    store.put(spark.createDataFrame([(f"k{i}", 100, i, i, "m") for i in range(25)], SCHEMA), ["created_at"])
    assert store.read().count() == 0  # not one fits
    store.put(spark.createDataFrame([("a", 1, 1, 1, "m")], SCHEMA), ["created_at"])
    assert [r.key for r in store.read().collect()] == ["a"]
    store.clear()
    assert store.read().count() == 0
