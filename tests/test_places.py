"""Sentences found in the texts of their element, and ranges cut out of a page."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.blocks import with_stamps
from lectern.operators.extract import extract
from lectern.operators.highlight import sentence_places
from lectern.operators.nodes import nodes


def stamped(spark, *pages):
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "page_id long, html string")
    return with_stamps(nodes(rows).withColumn("source", F.lit(""))).drop("source")


def test_places_in_one_page(spark):
    table = stamped(spark, "<p>ab <b>Rivers run</b> to the sea.</p><p>Then <i>all</i> is well.</p>", "<p>Rivers run. Rivers run.</p>")
    uids = {r.t_from: f"u{r.stamp}" for r in table.filter("page_id = 0 AND stamp IS NOT NULL").collect()}
    first, second = uids[0], uids[3]
    asked = [
        (0, 1, first, "Rivers run"),
        (0, 2, first, "[long-break] Rivers run to the sea. [break]"),
        (0, 3, second, "all is  well."),
        (0, 4, first, "sea"),  # too short to be looked for
        (0, 5, second, "Rivers run"),
        (0, 6, None, "Rivers run"),
        (0, 7, first, "n to"),
        (0, 8, "u99", "Rivers run"),
        (1, 9, "u1", "Rivers run."),
    ]
    got = {r.key: (r.piece, r.start, r.end) for r in sentence_places(spark.createDataFrame(asked, "page_id long, key int, uid string, text string"), table).collect()}
    assert got == {1: (1, 0, 10), 2: (1, 0, 10), 3: (1, 0, 3), 7: (1, 9, 10), 9: (0, 0, 11)}


def test_places_like_a_walk(spark):
    draw = random.Random(3)
    words = ["one", "two ", " three", "\n", "four five", "x"]
    html = ["".join(f"<p>{''.join(draw.choice(['<b>{}</b>', '{}', '<i>{}<u>{}</u></i>']).replace('{}', draw.choice(words)) for _ in range(8))}</p>" for _ in range(6)) for _ in range(8)]
    table = stamped(spark, *html)
    rows = table.collect()
    asked, want = [], {}
    for r in rows:
        if r.stamp is None:
            continue
        pieces = [(x.seq, x.text) for x in sorted(rows, key=lambda x: x.seq) if x.page_id == r.page_id and x.tag == "#text" and r.seq < x.seq < r.end]
        whole = "".join(t for _, t in pieces)
        for n in (4, 9, 60):
            at = draw.randrange(max(1, len(whole)))
            clean = " ".join(whole[at : at + n].split())
            key = len(asked)
            asked.append((r.page_id, key, f"u{r.stamp}", clean))
            found = whole.find(clean[:40])
            if len(clean) < 4 or found < 0:
                continue
            start = 0
            for k, (_, text) in enumerate(pieces):
                if start <= found < start + len(text):
                    want[key] = (k, found - start, min(found - start + len(clean), len(text)))
                start += len(text)
    got = {r.key: (r.piece, r.start, r.end) for r in sentence_places(spark.createDataFrame(asked, "page_id long, key int, uid string, text string"), table).collect()}
    assert got == want and len(want) > 20


HTML = "<body><div id='a'><h2>The first head line</h2><p>Some <b>bold words</b> of a long paragraph here.</p><ul><li>item number one</li><li>item number two</li></ul></div><p hidden>not seen</p><p>A last paragraph of words.</p></body>"


CASES = [
    # Two blocks in part, one whole: ids come along.
    ((0, 4, 3, 8), [("heading", "first head line"), ("paragraph", "Some bold words of a lo")]),
    ((2, 5, 4, 9), [("paragraph", "words of a long paragraph here."), ("list-item", "item numb")]),
    # Inside one text, and inside one paragraph over several.
    ((3, 1, 3, 26), [("paragraph", "of a long paragraph here.")]),
    ((1, 0, 3, 15), [("paragraph", "Some bold words of a long para")]),
    # Over hidden content, to the end and beyond it.
    ((5, 5, 7, 900), [("list-item", "number two"), ("paragraph", "A last paragraph of words.")]),
    ((0, 0, 0, 5), None),
    ((4, 3, 2, 1), None),
    ((0, 0, 99, 5), None),
]


@pytest.fixture(scope="module")
def cut_out(spark):
    rows = [(k, "https://x.example/", HTML, cut) for k, (cut, _) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, range struct<from_piece:int,from_at:int,to_piece:int,to_at:int>")
    return {r.page_id: r for r in extract(pages).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_ranges(cut_out, k):
    (cut, want), row = CASES[k], cut_out[k]
    if want is None:
        assert row.strategy != "selection"
    else:
        assert (row.strategy, [(b.kind, b.text) for b in row.blocks]) == ("selection", want)
        # Whole and partial elements keep their ids; a paragraph of loose text has that of what is around it, if any is named.
        assert [b.uid is not None for b in row.blocks] == [True] * len(want) or cut == (1, 0, 3, 15)
