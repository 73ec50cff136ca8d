"""Operator 7, against all pairs."""

import difflib
import random
import re
from collections import Counter

import numpy as np
import pytest
from lectern.llm import near_dedup as nd
from lectern.llm.components import components

DOCS = "doc_id long, text string, lang string"


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def said(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def similar(a, b):
    """Whether two lists of words are near copies, by the whole matrix; quick bounds first."""
    bound = lambda m: 5 * m >= 4 * (len(a) + len(b) - m)
    return bound((Counter(a) & Counter(b)).total()) and bound(longest_common(a, b))


def brute(docs):
    """Classes by all pairs."""
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = [(d, said(t)) for d, t in docs if said(t)]
    for k, (d, a) in enumerate(texts):
        for e, b in texts[:k]:
            if similar(a, b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: root(d) for d, _ in docs}


def test_alignment_decides_like_the_whole_matrix():
    rng = random.Random(2)
    for _ in range(4000):
        letters, n = rng.choice([2, 5, 50]), rng.randint(1, 14)
        a = [rng.randrange(letters) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at, what = rng.randrange(len(b) + 1), rng.random()
            b[at : at + (what < 0.6)] = [] if what < 0.3 else [rng.randrange(letters)]
        if b:
            want = 9 * longest_common(a, b) >= 4 * (len(a) + len(b))
            assert nd.alike(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def families(seed=5):
    """Near copies of an original at all distances, texts around one long passage, and chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    docs = []
    base = [word() for _ in range(120)]
    for k in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = word()
        docs.append(" ".join(text))
    passage = [word() for _ in range(70)]
    docs += [" ".join(passage + [word() for _ in range(rng.randint(5, 40))]) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for k in range(12):
        chain = chain[3:] + [word(), word(), word()]
        docs.append(" ".join(chain))
    docs += [" ".join(word() for _ in range(50)) for _ in range(30)]
    docs += docs[:5]
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("common", [32, 2])
def test_families(spark, monkeypatch, common):
    monkeypatch.setattr(nd, "COMMON", common)
    docs = families()
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)).collect()}
    want = brute(docs)
    assert len(set(want.values())) < len(docs)
    assert got == want


def test_real_near_copies(spark, tiny):
    """Against word-level ratios of another algorithm, over all pairs."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, said(r.text)) for r in docs if said(r.text)]
    pairs = []
    for k, (d, a) in enumerate(texts):
        for e, b in texts[:k]:
            n = len(a) + len(b)
            if a != b and 18 * (Counter(a) & Counter(b)).total() >= 16 * n / 2 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 8 / 9:
                pairs.append((d, e))
    assert len(pairs) >= 5
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.read.parquet(f"{tiny}/documents.parquet")).collect()}
    assert sum(got[d] == got[e] for d, e in pairs) >= 0.95 * len(pairs)


def test_short_and_spoiled_texts_meet():
    """Shares of pairs with a common band: short texts with one word changed, long ones with changes at random places."""
    rng = random.Random(4)
    word = lambda: b"%d" % rng.randrange(10**6)

    def share(n, changes, tries=150):
        met = 0
        for _ in range(tries):
            a = [word() for _ in range(n)]
            b = list(a)
            for at in rng.sample(range(n), changes):
                b[at] = word()
            met += bool(set(nd.sketched(a).tolist()) & set(nd.sketched(b).tolist()))
        return met / tries

    assert share(9, 1) > 0.97 and share(10, 1) > 0.97 and share(20, 2) > 0.97 and share(38, 4) > 0.97
    assert share(45, 4) > 0.85 and share(150, 9) > 0.95 and share(150, 16) > 0.85


def test_profiles_bound_the_matches():
    rng = random.Random(9)
    for _ in range(300):
        pool = [b"%d" % rng.randrange(10**6) for _ in range(rng.choice([5, 60, 900]))]
        a = [rng.choice(pool) for _ in range(rng.randint(1, 400))]
        b = [rng.choice(pool) if rng.random() < 0.1 else w for w in a][: rng.randint(1, 400)]
        x, y = nd.shingles(a, 1), nd.shingles(b, 1)
        if (Counter(a) & Counter(b)).total() >= nd.enough(len(a), len(b)):
            assert nd.may_match(len(a), nd.profile(x), len(b), nd.profile(y))
    many = nd.shingles([b"a"] * 70_000, 1)
    assert nd.profile(many) == b"" and nd.may_match(70_000, b"", 70_000, b"")


def test_a_document_with_two_texts(spark):
    rng = random.Random(8)
    one, two = ([f"w{rng.randrange(9999)}" for _ in range(60)] for _ in range(2))
    near = lambda t: " ".join([*t[:30], "new", *t[31:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, "other words")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS)
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert sorted((r.doc_id, r.text) for r in nd.keep_one(docs).collect()) == [(1, min(" ".join(one), " ".join(two))), (4, "other words")]


def test_edges(spark, edges, nothing):
    extra = spark.createDataFrame([(None, "a b c d", "en", "s", 7), (20, "A, B; c d", "en", "s", 9), (21, "a b c d", "en", "s", 7), (21, "quite another text of some words", "en", "s", 3), (22, "Quite another text of some words!", "en", "s", 3)], edges.schema)
    got = nd.near_duplicates(edges.union(extra))
    classes = {}
    for r in got.collect():
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert classes[20] == classes[21] == classes[22] == {20} and classes[None] == {None}
    assert [classes[k] for k in (1, 2, 3, 11)] == [{1}, {2}, {3}, {11}]
    assert classes[8] == {5} and got.count() == edges.count() + 5
    assert nd.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(900, 1000)] + [(k, k + 1) for k in range(400, 440)]
    parent = {x: x for link in links for x in link}
    for _ in range(100):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in parent.items() if x in got}
    assert all(parent[x] == x for x in parent if x not in got)
