"""Keys, hits, billing, eviction, look-ahead, voices."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import accounting as A


def test_keys_are_those_of_json(spark):
    texts = ["plain", 'quo"te \\ back', "tab\t\n\x0b\x1f\x0e", "é漢\U0001f600", "\\u000B \x0b", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.x for r in df.select("k", A.cache_key(F.col("t"), F.lit("v"), F.lit("m"), 1.25, 0).alias("x")).orderBy("k").collect()]
    want = [hashlib.sha256(json.dumps([t, "v", "m", 1.25, 0], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for t in texts]
    assert got == want


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def cache(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(f"k{k}", rng.randint(1, 50), rng.randint(0, 9), rng.randint(0, 9)) for k in range(200)], "key string, bytes long, created_at long, last_used long")


@pytest.mark.parametrize("budget", [0, 1000, 10**9])
def test_eviction(cache, budget):
    held = sorted(cache.collect(), key=lambda r: (r.last_used, r.key))
    total, gone = sum(r.bytes for r in held), []
    for r in held:
        if total <= budget:
            break
        gone.append(r.key)
        total -= r.bytes
    assert [k for (k,) in rows(A.evicted(cache, budget), "key")] == sorted(gone)
    both = cache.withColumn("tab", F.lit(1)).union(cache.withColumn("tab", F.lit(2)))
    assert A.evicted(both, budget, ("tab",)).count() == 2 * len(gone)


def test_running_total_over_ranges(cache):
    held = sorted(cache.collect(), key=lambda r: (r.last_used, r.key))
    total, want = 0, []
    for r in held:
        total += r.bytes
        want.append((r.key, total))
    assert rows(A.running_total(cache, "bytes", ["last_used", "key"]), "key", "cum") == sorted(want)


def test_hits_billing_and_cost(spark):
    log = spark.createDataFrame([(1, "a", 10, "pro"), (2, "a", 10, "pro"), (3, "b", 5, "odd"), (4, "a", 10, "pro")], "seq int, key string, bytes long, model string")
    hit = A.hits_and_misses(log, "key", ["seq"])
    assert rows(hit, "seq", "hit") == [(1, False), (2, True), (3, False), (4, True)]
    sums = A.with_cost(A.billed(hit, ("model",)))
    assert rows(sums, "model", "bytes_billed", "cache_hits", "cost") == [("odd", 5, 0, 0.0), ("pro", 10, 2, 10 / 1e6 * 15)]
    stored = log.select("key").filter("key = 'a'")
    assert rows(A.against_cache(log, stored.union(stored)), "seq", "hit") == [(1, True), (2, True), (3, False), (4, True)]
    assert A.has(log, stored).count() == 3 and A.missing(log, stored).count() == 1
    assert A.in_flight(log.union(log), "model", "key").count() == 2


def test_put_and_touch(spark):
    kind = "key string, bytes long, created_at long, last_used long"
    cache = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 2, 2)], kind)
    new = spark.createDataFrame([("a", 9, 5, 5), ("c", 3, 3, 3), ("a", 8, 4, 9)], kind)
    assert rows(A.put(cache, new), "key", "bytes") == [("a", 9), ("b", 2), ("c", 3)]
    reads = spark.createDataFrame([("a", 7), ("a", 6), ("z", 1)], "key string, at long")
    assert rows(A.touched(cache, reads), "key", "last_used") == [("a", 7), ("b", 2)]
    assert rows(A.put_over_quota(cache, new, budget=4), "key", "bytes") == [("a", 9), ("b", 2), ("c", 3)]
    assert A.size(cache).first().asDict() == {"bytes": 3, "entries": 2} and A.size(cache.limit(0)).first().bytes == 0


def test_windows(spark):
    u = spark.createDataFrame([(1, k, 5) for k in range(5)], "page_id long, utt_seq int, bytes long")
    assert rows(A.look_ahead(u, "page_id", "utt_seq", 2), "utt_seq", "window_seqs") == [(k, [*range(k, min(5, k + 3))]) for k in range(5)]
    assert rows(A.look_ahead(u, "page_id", "utt_seq", -3), "window_seqs") == [([k],) for k in range(5)]
    assert len(A.look_ahead(u, "page_id", "utt_seq", 99).filter("utt_seq = 0").first().window_seqs) == 5
    assert rows(A.progress(u, "page_id", "utt_seq"), "progress") == [(0.2,), (0.4,), (0.6,), (0.8,), (1.0,)]
    assert rows(A.queue_signature(u, "page_id", F.lit("v"), F.lit("m")), "signature") == [("5:25:v:m",)]
    held = spark.createDataFrame([(1, k, 4) for k in range(10)], "t int, i int, head int")
    assert rows(A.out_of_memory(held, "t", "i", "head"), "i") == [(0,), (1,), (8,), (9,)]


def test_voices(spark):
    cat = spark.createDataFrame([(f"v{k}", "tts" if k % 3 else "asr", "trained" if k % 4 else "new", float(k % 5) if k != 7 else None) for k in range(30)], "id string, type string, state string, score double")
    first, second = A.voices(cat, 5, 1).collect(), A.voices(cat, 5, 2).collect()
    usable = sorted((r for r in cat.collect() if r.type == "tts" and r.state == "trained"), key=lambda r: (r.score is None, -(r.score or 0), r.id))
    assert [r.id for r in first + second] == [r.id for r in usable[:10]] and A.voices(cat, 0).count() == 1
    probes = spark.createDataFrame([("a", 0, "x", 5, "t1"), ("b", 1, "x", 7, "t2"), ("b", 1, "y", 9, "t3")], "probe string, seq int, id string, likes long, title string")
    assert [(r.id, r.likes, r.title, r.matched_by) for r in A.merged_voices(probes).collect()] == [("y", 9, "t3", ["b"]), ("x", 5, "t1", ["a", "b"])]
    raw = spark.createDataFrame([("i", None, None, None, None, None, None, None, None)], "id string, title string, languages array<string>, tags array<string>, likes long, tasks long, author string, description string, sample_url string")
    assert A.normalized_voices(raw).first().asDict() == {"id": "i", "title": "Untitled", "languages": [], "tags": [], "likes": 0, "tasks": 0, "author": "", "description": "", "sample_url": ""}
    urls = spark.createDataFrame([("https://a",), ("javascript:x",)], "u string").select(A.safe_sample(F.col("u")).alias("x"))
    assert [r.x for r in urls.collect()] == ["https://a", None]


def test_statuses(spark):
    got = spark.createDataFrame([(401,), (429,), (500,), (599,), (600,)], "s int").select(A.retryable(F.col("s")).alias("r"), A.error_hint(F.col("s")).alias("h")).collect()
    assert [tuple(x) for x in got] == [(False, "key"), (True, "rate"), (True, "server"), (True, "server"), (False, "other")]


def test_hits_with_null_keys_and_ties(spark):
    log = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, None, "x"), (5, "a", "y"), (1, "a", "x")], "n int, k string, c string")
    got = sorted((r.n, r.k or "", r.c, r.hit) for r in A.hits_and_misses(log, "k", ["n"], ("c",)).collect())
    assert got == [(1, "a", "x", False), (1, "a", "x", False), (2, "a", "x", True), (3, "", "x", False), (4, "", "x", True), (5, "a", "y", False)]
    assert A.hits_and_misses(log.limit(0), "k", ["n"]).count() == 0
