"""The stages of the pipeline, each on what the one before kept, against brute force."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
pipeline = pytest.importorskip("corpus_pipeline")

from test_decontamination import brute as contaminated  # noqa: E402
from test_lines_and_quality import lines_kept  # noqa: E402
from test_near_dedup import brute as classes  # noqa: E402

from lectern.llm.common import crc_of_id, persisted, table  # noqa: E402
from lectern.llm.toxicity import toxicity  # noqa: E402


def test_every_stage(spark, tiny):
    docs = table(spark, tiny, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = persisted(stage(spark, docs, tiny), name.replace(" ", "_"))
        kept[name] = before, docs
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    before, after = kept["toxicity"]
    scored = toxicity(before, table(spark, tiny, "labels"), crc_of_id("doc_id") % 5 == 0)
    assert ids(after) == ids(scored.filter("predicted = 0")) and after.columns == columns

    before, after = kept["line dedup"]
    assert sorted((r.doc_id, r.text) for r in after.collect()) == [(r[0], r[3]) for r in lines_kept(before.collect())]
    assert all(r.n_chars == len(r.text) for r in after.collect()) and after.columns == columns

    before, after = kept["near dedup"]
    want = classes([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted(d for d, c in want.items() if d == c) and after.columns == columns

    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, tiny, "benchmark").collect()]
    assert ids(after) == [r[0] for r in contaminated([(r.doc_id, r.text) for r in before.collect()], items) if not r[4]]
    assert after.columns == columns

    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {*ids(before)}


def test_edges(spark, edges, nothing, tiny):
    extra = spark.createDataFrame([(None, "text without an id", "en", "s", 18)] * 2, edges.schema)
    for start in (edges.union(extra), nothing):
        docs = start
        for name, stage in pipeline.STAGES:
            docs = persisted(stage(spark, docs, tiny), name.replace(" ", "_"))
        assert docs.columns[0] == "doc_id"
    assert docs.count() == 0
