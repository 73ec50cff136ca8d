"""Operator 10, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from lectern.llm import suffix_dedup as sd


def brute(docs):
    """(doc_id, text) rows in order; rows of equal id and text count once."""
    seen, out, done = {}, [], {}
    for key, text in docs:
        data = (text or "").encode()
        if (key, data) not in done:
            covered = np.zeros(len(data), bool)
            for i in range(len(data) - 99):
                if data[i : i + 100] in seen:
                    covered[i : i + 100] = True
                seen.setdefault(data[i : i + 100], i)
            kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
            spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
            done[key, data] = (len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
        out.append((key, *done[key, data]))
    return out


def found(df):
    key = lambda r: (r[0] is not None, r)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=key)


def expected(rows):
    key = lambda r: (r[0] is not None, r)
    return sorted(brute([(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]), key=key)


@pytest.mark.parametrize("block", [20_000, 3])
def test_documents(small, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    want = expected(small.collect())
    assert sum(r[2] for r in want) > 1000
    assert found(sd.dedup_substrings(small)) == want


def test_edges(spark, edges, nothing):
    extra = spark.createDataFrame([(None, "same line of text " * 20, "en", "s", 1), (30, "same line of text " * 9, "en", "s", 1), (31, "x" * 300 + "é" * 200, "en", "s", 1), (32, "é" * 150, "en", "s", 1)], edges.schema)
    docs = edges.union(extra)
    got = sd.dedup_substrings(docs.withColumn("doc", docs.lang).withColumn("n_spans", docs.lang))
    assert found(got) == expected(docs.collect())
    assert found(sd.dedup_substrings(nothing)) == []


@pytest.mark.parametrize("seed", range(4))
def test_repetitive_texts(spark, monkeypatch, seed):
    monkeypatch.setattr(sd, "CHUNK", 700)
    monkeypatch.setattr(sd, "MERGED", 500)
    monkeypatch.setattr(sd, "SORTED", 60)
    rng = random.Random(seed)
    parts = ["".join(rng.choices("ab" if k % 2 else "abcdefgh", k=rng.choice([3, 40, 99, 100, 101, 180, 900]))) for k in range(10)]
    docs = [(d, "".join(rng.choices(parts, k=rng.randint(0, 5)))) for d in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(sd.dedup_substrings(df)) == expected(df.collect())


def test_equal_ids_with_other_texts(spark):
    a, b = "p" * 10 + "same" * 50, "same" * 50 + "q" * 10
    rows = found(sd.dedup_substrings(spark.createDataFrame([(1, a), (1, b), (2, a), (1, a)], "doc_id long, text string")))
    assert len(rows) == 4 and [r[2] for r in rows if r[0] == 2] == [210]


def test_merged_spans():
    starts, ends = sd.merged_spans(np.array([5, 0, 7, 30]), np.array([9, 5, 12, 31]))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 12), (30, 31)]


def rotations(x):
    """The order of the rotations of x by their first 128 bytes, by doubling."""
    rank = x.astype(np.int64)
    for k in (1, 2, 4, 8, 16, 32, 64):
        key = rank * (len(x) + 256) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
    return order


def merged_transforms(one, two, rounds=100):
    """Merges the Burrows-Wheeler transforms of two shards: each round sorts the interleave, stably, by the transforms'
    symbols, so after k rounds suffixes stand in the order of k bytes; blocks are those of equal ones. Returns each place's
    shard, suffix and block."""
    orders = [rotations(one), rotations(two)]
    shard, block = np.repeat([0, 1], [len(one), len(two)]), np.zeros(len(one) + len(two), np.int64)
    for _ in range(rounds):
        symbol = np.empty(len(shard), np.uint8)
        for k, x in enumerate((one, two)):
            symbol[shard == k] = x[orders[k] - 1]
        order = np.argsort(symbol, kind="stable")
        shard, before, symbol = shard[order], block[order], symbol[order]
        block = np.cumsum(np.concatenate([[0], (np.diff(symbol.astype(int)) != 0) | (np.diff(before) != 0)]))
    place = np.empty(len(shard), np.int64)
    for k in (0, 1):
        place[shard == k] = orders[k]
    return shard, place, block


def test_like_merged_transforms(spark):
    """The method by the book on two shards: its repeated intervals are what the operator removes."""
    rng = random.Random(12)
    parts = ["".join(rng.choices("abcd", k=rng.choice([60, 130, 400]))) for _ in range(8)]
    docs = [(d, "".join(rng.choices(parts, k=3)) + "".join(rng.choices("abcd", k=90))) for d in range(40)]
    shards = [np.frombuffer("".join(t + "\0" for _, t in docs[k : k + 20]).encode(), np.uint8) for k in (0, 20)]
    shard, place, block = merged_transforms(*shards)
    at = place + shard * len(shards[0])
    whole = np.concatenate(shards)
    ends = np.flatnonzero(whole == 0)
    inside = ends[np.searchsorted(ends, at)] - at >= 100
    firsts = np.full(block.max() + 1, len(whole))
    np.minimum.at(firsts, block[inside], at[inside])
    gone = np.zeros(len(whole), bool)
    for start in at[inside & (at != firsts[block])]:
        gone[start : start + 100] = True
    want = dict(zip((d for d, _ in docs), np.add.reduceat(gone, np.concatenate([[0], ends[:-1] + 1])).tolist(), strict=True))
    got = sd.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(want.values()) > 5000 and {r.doc_id: r.n_removed for r in got} == want
