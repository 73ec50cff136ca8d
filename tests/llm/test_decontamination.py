"""Operator 6, against brute force."""

import random
import re

import numpy as np
import pytest
from lectern.llm import decontamination
from lectern.llm.decontamination import contamination
from lectern.llm.queries import table
from lectern.llm.words import word_count
from lectern.llm.words import words as split
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (of := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= of
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect())


@pytest.mark.parametrize("bits", [22, 8])
def test_all_documents(spark, tiny, bits):
    docs, items = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[4] for r in want)
    assert got(contamination(docs, items, log2_bits=bits)) == want


ITEMS = [(1, "Zu WENIG ä öl"), (2, None), (3, ""), (4, "a b c d e f g a b c d"), (4, "other same line"), (5, "word1 tail1 word2 tail2, word3 tail3 word4 tail4 word5 tail5 word6"), (None, "漢字 \U0001f600"), (6, "f g a"), (7, "more"), (7, "SAME"), (8, "same"), (9, "x x x")]


@pytest.mark.parametrize("bits", [22, 6])
def test_edges(spark, edges, nothing, bits):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = edges.withColumn("items", edges.lang).withColumn("n_hit", edges.lang)
    want = brute([(r.doc_id, r.text) for r in edges.collect()], ITEMS)
    assert sum(r[4] for r in want) >= 4
    assert got(contamination(docs, items, log2_bits=bits)) == want
    assert got(contamination(nothing, items, log2_bits=bits)) == []
    assert not any(r[4] for r in got(contamination(docs, items.limit(0), log2_bits=bits)))


@pytest.mark.parametrize("most", [27, 13])
def test_tokens_in_turns_and_shared_windows(spark, most):
    """Windows of many items in many surroundings; filters of so few bits that passes go in turns."""
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    shared, second = ([word() for _ in range(12)] for _ in range(2))
    items = [(k, " ".join([*shared, *(word() for _ in range(k % 4))])) for k in range(60)]
    items += [(k, " ".join(second)) for k in range(30, 45)] + [(100 + k, " ".join(word() for _ in range(30))) for k in range(40)]
    docs = [(k, " ".join([*(word() for _ in range(20)), *shared, *(word() for _ in range(20)), *(second if k % 3 else [])])) for k in range(80)]
    docs += [(200 + k, items[60 + k][1]) for k in range(40)] + [(300, " ".join(word() for _ in range(300)))]
    given = spark.createDataFrame(items, "item_id long, text string")
    tokens = decontamination.item_windows(given, 10).select(F.explode("tokens").alias("token"))
    turns = decontamination.in_turns(tokens, None, most)
    assert (len(turns) > 1) == (most < 27)
    assert sum(t.select("token").distinct().count() for t, _ in turns) == tokens.distinct().count()
    assert got(contamination(spark.createDataFrame(docs, "doc_id long, text string"), given, most_bits=most)) == brute(docs, items)


def test_the_filter_grows_with_the_tokens(spark):
    """Shares of foreign tokens that pass."""
    rng = np.random.default_rng(1)
    foreign = rng.integers(0, 2**64, 200_000, dtype=np.uint64)
    for n in (500, 300_000):
        tokens = spark.range(n).select(F.xxhash64("id").alias("token"), F.lit("a b").alias("window"))
        ((part, log2_bits),) = decontamination.in_turns(tokens, None)
        bits, single = decontamination.token_filter(part, log2_bits)
        assert not single and len(decontamination.passing(foreign, bits)) < 0.02 * len(foreign)
        own = np.array([r.token for r in tokens.limit(500).collect()], np.int64).view(np.uint64)
        assert len(decontamination.passing(own, bits)) == len(own)


def test_word_counts():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices("aB9 \t.-\né漢@[`{\x7f\x00", k=rng.randrange(40))).encode()
        assert word_count(text) == len(split(text))
