"""Operator 11, against a direct computation."""

import math
import re
from collections import Counter, defaultdict

import pytest
from lectern.llm import search as S
from lectern.llm.search import index, item_terms, search

ITEMS = "item_id long, text string, n long, term string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def ranked(docs, items, top=10):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    count, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, c in asked.items():
        scores = []
        for d, has, n in docs:
            m = 25 + (75 * n * count) // total
            s = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * has[t]) // (1000 * has[t] + 8 * m)) for t, q in c.items() if t in has)
            if s > 0:
                scores.append((-s, d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[:top])]
    return sorted(out)


def found(docs, items, whole=False):
    asked = item_terms(items)
    return sorted(map(tuple, search(index(docs, None if whole else asked), asked).select("item_id", "rank", "doc_id", "score").collect()))


@pytest.fixture(scope="module")
def questions(spark):
    said = ["shared line of text", "WORD1 tail2 a, b", None, "", "nothing has this", "Öl 漢字 zu zu zu", "g", "that is shared: other other more"]
    rows = [(k, t, 1, "x") for k, t in enumerate(said)]
    return spark.createDataFrame([*rows, rows[0], (1, "more", 2, "y")], ITEMS)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("table", ["small", "edges"])
def test_ranks(request, questions, table, whole):
    docs = request.getfixturevalue(table).withColumnRenamed("lang", "term")
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in questions.collect()])
    assert found(docs, questions, whole) == want and want


def test_nothing(spark, nothing, edges, questions):
    assert found(nothing, questions) == [] == found(edges, questions.limit(0))


def test_ties_and_null_ids(spark):
    docs = spark.createDataFrame([(d, "same words here") for d in (5, 3, None, 9, 3)] + [(7, "others"), (8, "more others"), (10, "x y z"), (11, "y"), (12, "z"), (13, "w")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = search(index(docs), item_terms(items), top=4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [None, 3, 3, 5] and len({r.score for r in got}) == 1


def test_blocks_of_items_and_joined_terms_change_nothing(monkeypatch, small, questions):
    want = found(small, questions)
    monkeypatch.setattr(S, "BLOCK_TERMS", 5)
    assert found(small, questions) == want
    monkeypatch.setattr(S, "SHIPPED_TERMS", 3)
    assert found(small, questions) == want


def test_no_part_holds_a_common_term(spark):
    """A term of all documents is dealt to many parts."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('common w', id) AS text")
    sizes = index(docs).postings.filter("term = 'common'").selectExpr("pmod(xxhash64(row), 32) AS way").groupBy("way").count().collect()
    assert len(sizes) == 32 and max(r["count"] for r in sizes) < 300
