"""Operators 8 and 9, against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.quality import judge

BLANK = " \t\n\x0b\x0c\r"


def lines_kept(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(BLANK).translate(low)
    holders = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r.doc_id)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or r.doc_id == max(holders[key(x)])]
        out.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("table", ["small", "edges", "nothing"])
def test_line_dedup(request, table):
    docs = request.getfixturevalue(table)
    got = dedup_lines(docs.withColumn("n_lines", docs.lang))
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == lines_kept(docs.collect())


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("table", ["small", "edges", "nothing"])
def test_measures(request, table):
    docs = request.getfixturevalue(table)
    got = judge(docs.withColumn("n_words", docs.lang))
    key = lambda x: (x[0] is not None, x)
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()), key=key)
    assert found == sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=key)
    assert not got.filter("base_failed AND kept").count()


def test_verdicts_agree_with_labels(spark):
    """Labels are not used in fitting; clean documents stay and junk goes."""
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").withColumnRenamed("quality", "label")
    rows = judge(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.label == 1)
    assert sum(not r.kept for r in rows if r.label == 0) >= 0.95 * sum(r.label == 0 for r in rows)
