"""Parts of the adapters: furniture and stops by structure, answers, climbing, captions."""

import random
import time

import pytest

from lectern.operators.adapters import restated
from lectern.operators.extract import extract

LONG = "These are the words of a paragraph that is long enough, with commas, to be read as prose. "
PAGES = {
    1: (
        "https://en.wikipedia.org/wiki/Y",
        f"<div class='mw-parser-output'><p>{LONG}</p><div class='thumb'><div class='magnify'><p>enlarge this picture</p></div><div class='thumbcaption'>A caption of its own</div></div>"
        "<div class='magnify'><p>magnified by itself</p></div><table class='wikitable'><tr><td>a</td><td>b</td></tr></table><div class='reflist x'><p>a list of notes</p></div>"
        "<div class='NavContent'><p>kept here</p><div class='translations'><p>not this one</p></div></div><h2 id='Notes'>Remarks</h2><p>Cut off by the id.</p></div>",
    ),
    2: ("https://en.wikipedia.org/wiki/Z", f"<div class='mw-parser-output'><p>{LONG}</p><h2><span class='mw-headline' id='See_also'>More of it</span></h2><p>Cut off too.</p></div>"),
    3: ("https://en.wikipedia.org/wiki/W.pdf", f"<div class='mw-parser-output'><p>{LONG}</p></div>"),
    4: ("https://x.example/view", "<embed type='application/pdf' src='x'><p>hi</p>"),
    5: (
        "https://stackoverflow.com/questions/2/y",
        "<h1>Title</h1><div id='question'><div class='s-prose'><p>Why is it so?</p></div></div>"
        "<div class='answer'><div class='post-text'><p>Old markup.</p></div><div class='answer'><div class='s-prose'><p>Prose inside of it.</p></div></div></div>"
        "<div class='answer'><div class='s-prose'><p>Marked as right.</p></div><span class='js-accepted-answer-indicator'></span></div>"
        "<div class='answer'><div class='s-prose'><p>Not marked.</p></div><span class='js-accepted-answer-indicator d-none'></span></div>",
    ),
    6: ("https://y.medium.com/p", f"<article><div><section><h1>Lead</h1></section></div><section><p class='pw-post-body-paragraph'>{LONG}</p><p>And more.</p></section></article>"),
    7: ("https://z.medium.com/p", f"<article><div><section><p>{LONG}</p></section></div><section><p>second part</p></section></article>"),
}


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(k, *v) for k, v in PAGES.items()], "page_id long, url string, html string")
    return {r.page_id: r for r in extract(pages).collect()}


def said(row):
    return [b.text.strip() for b in row.blocks]


def test_wiki_structure(found):
    assert said(found[1]) == [LONG.strip(), "magnified by itself", "a, b", "kept here", "A caption of its own"] or said(found[1]) == [LONG.strip(), "A caption of its own", "magnified by itself", "a, b", "kept here"]
    assert said(found[2]) == [LONG.strip()]


def test_adapters_that_read_nothing_yield(found):
    assert found[3].strategy == "adapter:wikipedia" and found[4].strategy == "none" and "PDF" in found[4].reason


def test_answers(found):
    assert said(found[5]) == ["Title", "Question", "Why is it so?", "Accepted answer", "Marked as right.", "Answer 2", "Prose inside of it.", "Answer 3", "Not marked."]


def test_containers_by_structure(found):
    assert said(found[6]) == [LONG.strip(), "And more."] or said(found[6]) == ["Lead", LONG.strip(), "And more."]
    assert said(found[7]) == [LONG.strip()]


def test_restated_like_brute_force(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choices("abc d", k=draw.randint(1, n)))
    hay = [(p, text(40)) for p in range(6) for _ in range(8)]
    needles = [(p, t[i : i + draw.randint(1, 9)] if draw.random() < 0.5 else text(7)) for p, t in hay for i in (0, 3)]
    needles = [(p, t) for p, t in needles if len(t) > 2]
    got = restated(spark.createDataFrame(needles, "page_id long, text string"), spark.createDataFrame(hay, "page_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(p, t) for p, t in needles if any(q == p and t in x for q, x in hay)}


def test_many_captions_and_blocks(spark):
    """10,000 of each on one page, half of the captions restated: work grows with the texts."""
    hay = [(1, f"block number {k} of the page says this") for k in range(10_000)]
    needles = [(1, f"number {k} of the page" if k % 2 else f"caption {k} alone") for k in range(10_000)]
    began = time.time()
    got = restated(spark.createDataFrame(needles, "page_id long, text string"), spark.createDataFrame(hay, "page_id long, text string")).count()
    assert got == 5_000 and time.time() - began < 90
