"""Pages to blocks: kinds, hidden and loose content, density, adapters, metadata, fallbacks."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.adapters import REGISTRY
from lectern.operators.density import article_score, features
from lectern.operators.extract import NOTHING, extract
from lectern.operators.nodes import nodes
from lectern.sources.tables import from_documents, from_pdf, from_selection, is_pdf, readable

LONG = "This is a sentence with enough words, and commas, to count as prose for the score of density. "
PAGES = {
    1: (
        "https://a.example/kinds",
        f"""<html lang="de-AT, en"><head><title> A  title </title><meta property="og:site_name" content="Site"><meta name="author" content="Ann B."></head><body>
        <nav><a href="/x">menu menu menu</a></nav><article><h1>Main &amp; head</h1><p>{LONG * 4}<b>anti</b>pattern<p>Second one is unclosed, {LONG}
        <ul><li>first item<li>second <em>item</em></ul><blockquote>quoted words here</blockquote><pre>a = 1  \n\n\n\nb = 2\n</pre>
        <figure><img src="x" alt="alt text here"><figcaption>A caption of note</figcaption></figure><img src="y" alt="lone picture"><img alt="no">
        <table><tr><th>Port</th><th>Depth</th></tr><tr><td>Brest</td><td>14m</td></tr></table><table><tr><td>{LONG}one cell</td></tr></table>
        <dl><dt>term</dt><dd>meaning of it</dd></dl><math alttext="x squared"><mi>x</mi></math><div role="heading" aria-level="4">Small head</div>
        <p hidden>gone one</p><p style="display: none">gone two</p><p aria-hidden="true">gone three</p><script>var t="</p>gone four";</script>
        <aside><p>gone five as furniture</p></aside><p>a<br>b</p></article><footer>gone six</footer></body></html>""",
    ),
    2: ("https://b.example/app", f"<body><div id=app><div class=wrap><div>{LONG}</div><div>{LONG}two</div><div><span>{LONG}</span> and <span>three</span></div></div></div></body>"),
    3: ("https://c.example/short", "<title>Short</title><body><p>Too short.</p></body>"),
    4: ("https://c.example/nothing", ""),
    5: ("https://d.example/two", f"<body><div class='sidebar'><ul>{'<li><a href=x>a link of the menu to follow</a></li>' * 20}</ul></div><div class='story'><p>{LONG}</p><p>{LONG}x</p></div></body>"),
    10: ("https://en.wikipedia.org/wiki/X", f"<h1>X</h1><div id='mw-content-text'><div class='mw-parser-output'><table class='infobox'><tr><td>box</td><td>of facts</td></tr></table><p>{LONG}<sup class='reference'>[1]</sup></p><h2>History<span class='mw-editsection'>[edit]</span></h2><p>Old words.</p><div class='thumb'><div class='thumbcaption'>Tiny one</div></div><h2 id='References'>References</h2><div class='thumbcaption'>Late one</div><ul><li>some author name</li></ul></div></div>"),
    11: ("https://stackoverflow.com/questions/1/x", "<h1>Title here</h1><div id='question'><div class='s-prose'><p>What is this thing?</p></div><div class='comments'>meh</div></div><div class='answer' id='answer-1'><div class='s-prose'><p>First reply text.</p></div></div><div class='answer accepted-answer' id='answer-2'><div class='s-prose'><p>Right reply text.</p></div></div>"),
    12: ("https://arxiv.org/abs/2301.1", "<h1 class='title mathjax'><span>Title:</span> A Paper</h1><div class='authors'>Authors: A, B</div><blockquote class='abstract mathjax'>Abstract: We show things.</blockquote>"),
    13: ("https://github.com/a/b/blob/main/x.py", "<body><textarea id='read-only-cursor-text-area'>import os\nprint(1)\n</textarea></body>"),
    14: ("https://github.com/a/b", f"<article class='markdown-body'><h1>Read me<a class='anchor'>#</a></h1><p>{LONG}</p></article>"),
    15: ("https://x.medium.com/p", f"<article><section><h1>Tale</h1><p>{LONG}</p><p>Share</p><p>Kept too.</p><h2>More from us</h2><p>cut off</p></section></article>"),
    16: ("https://docs.google.com/document/d/1", "<div class='kix-paragraphrenderer'>First kix paragraph</div><div class='kix-paragraphrenderer'>Second kix</div>"),
    17: ("https://docs.google.com/document/d/2", "<canvas class='kix-canvas-tile-content'></canvas>"),
    18: ("https://me.notion.site/n", "<div class='notion-page-content'><div placeholder='Untitled'>Notes</div><div class='notion-header-block'>Part</div><div class='notion-text-block'>Some text.</div><div class='notion-bulleted_list-block'>A point</div></div>"),
    19: ("https://e.example/file.PDF?x=1", "<body></body>"),
    20: ("about:blank", f"<p>{LONG * 5}</p>"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, url, html, None) for k, (url, html) in PAGES.items()] + [(30, "https://s.example/", f"<p>{LONG * 5}</p>", "these words  were selected by hand"), (31, "https://s.example/", f"<p>{LONG * 5}</p>", "x" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, selection string")
    return {r.page_id: r for r in extract(readable(pages)).collect()}


def said(row):
    return [(b.kind, b.text) for b in row.blocks]


def test_kinds(found):
    row = found[1]
    blocks = said(row)
    assert (row.title, row.site_name, row.byline, row.lang, row.strategy) == ("A title", "Site", "Ann B.", "de-AT", "readability")
    assert blocks[0] == ("heading", "Main & head") and row.blocks[0].level == 1
    assert blocks[1][0] == "paragraph" and blocks[1][1].endswith("antipattern") and blocks[2][1].startswith("Second one")
    assert ("list-item", "first item") in blocks and ("list-item", "second item") in blocks and ("quote", "quoted words here") in blocks
    assert ("code", "a = 1\n\nb = 2") in blocks and ("figure", "A caption of note") in blocks and ("figure", "lone picture") in blocks
    table = next(b for b in row.blocks if b.kind == "table")
    assert table.text == "Port, Depth. Brest, 14m" and (table.meta.rows, table.meta.cols) == (2, 2) and table.meta.cells == [["Port", "Depth"], ["Brest", "14m"]]
    assert ("paragraph", f"{LONG}one cell") in blocks and ("list-item", "meaning of it") in blocks and ("math", "x squared") in blocks
    assert ("heading", "Small head") in blocks and ("paragraph", "a b") in blocks
    assert not any("gone" in t or "menu" in t for _, t in blocks)
    assert [b.id for b in row.blocks] == [f"b{k}" for k in range(len(row.blocks))]
    uids = [b.uid for b in row.blocks if b.uid]
    assert len(uids) == len(set(uids)) > 8


def test_loose_containers(found):
    """Innermost containers with text; a block that is part of the next one gives way to it."""
    assert [(k, t.strip()) for k, t in said(found[2])] == [("paragraph", f"{LONG}two"), ("paragraph", f"{LONG.strip()} and three")]


def test_failures(found):
    assert (found[3].ok, found[3].strategy, found[3].reason, found[3].title, found[3].blocks) == (False, "none", NOTHING, "Short", [])
    assert not found[4].ok and found[4].title == "c.example"
    assert not found[17].ok and "canvas" in found[17].reason
    assert not found[19].ok and "PDF" in found[19].reason
    assert 20 not in found


def test_menus_lose(found):
    assert [k for k, _ in said(found[5])] == ["paragraph"] and "link of the menu" not in str(said(found[5]))


def test_selection(found):
    assert found[30].strategy == "selection" and said(found[30]) == [("paragraph", "these words were selected by hand")]
    assert found[31].strategy == "density" and found[2].strategy == "density"


def test_adapters(found):
    assert found[10].strategy == "adapter:wikipedia"
    assert [t.strip() for _, t in said(found[10])] == [LONG.strip(), "History", "Old words.", "Tiny one"]
    assert found[10].blocks[-1].kind == "figure"
    assert said(found[11]) == [("heading", "Title here"), ("heading", "Question"), ("paragraph", "What is this thing?"), ("heading", "Accepted answer"), ("paragraph", "Right reply text."), ("heading", "Answer 2"), ("paragraph", "First reply text.")]
    assert said(found[12]) == [("heading", "A Paper"), ("paragraph", "Authors: A, B"), ("heading", "Abstract"), ("paragraph", "We show things.")]
    assert said(found[13]) == [("heading", "x.py"), ("code", "import os\nprint(1)")] and found[13].blocks[1].meta.lines == 2
    assert said(found[14])[0] == ("heading", "Read me") and found[14].strategy == "adapter:github"
    assert [t.strip() for _, t in said(found[15])] == ["Tale", LONG.strip(), "Kept too."]
    assert said(found[16]) == [("paragraph", "First kix paragraph"), ("paragraph", "Second kix")]
    assert said(found[18]) == [("heading", "Notes"), ("heading", "Part"), ("paragraph", "Some text."), ("list-item", "A point")]
    assert [a.name for a in REGISTRY] == ["pdf", "wikipedia", "google-docs", "notion", "github", "stack-exchange", "arxiv", "medium-substack"]


def test_nodes_are_intervals(spark):
    rows = sorted(nodes(spark.createDataFrame([(1, "<p>a<b>b<p>c<br></i>d<script>x</p></script><svg/>e&nbsp;&lt;"), (2, None)], "page_id long, html string")).collect(), key=lambda r: (r.page_id, r.seq))
    assert {r.page_id for r in rows} == {1} and [r.seq for r in rows] == [*range(len(rows))]
    by = {r.seq: r for r in rows}
    for r in rows:
        above, up = [], r.parent
        while up is not None:
            above.append(up)
            up = by[up].parent
        assert above == [x.seq for x in reversed(rows) if x.seq < r.seq < x.end]
        assert r.is_text or r.near == [*reversed(above[:7]), r.seq]
        elder = [x.seq for x in rows if not x.is_text and x.parent == r.parent and x.seq < r.seq]
        assert r.is_text or r.before == max(elder, default=None)
        texts = [x.t_from for x in rows if x.tag == "#text" and r.seq <= x.seq < r.end]
        assert texts == [*range(r.t_from, r.t_to)]
    assert "".join(r.text for r in rows if r.tag == "#text") == "abcdx</p>e\xa0<"


def test_article_score(spark):
    pages = [(1, f"<p>{LONG * 4}</p><p>{LONG * 4}</p>"), (2, f"<ul><li><p>{LONG * 9}</p></li></ul>"), (3, f"<div class='sidebar'>{LONG * 9}<br></div>"), (4, f"<div>{LONG * 9}<br>x</div>"), (5, "<p>x</p>")]
    got = {r.page_id: r.is_article for r in article_score(features(nodes(spark.createDataFrame(pages, "page_id long, html string")))).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_other_sources(spark):
    pdf = spark.createDataFrame([(1, "https://x.example/a%20b.pdf?v=1", [["one ", " two"], [" "], ["three"]]), (2, "https://x.example/", [[" "]])], "page_id long, url string, page_items array<array<string>>")
    a, b = sorted(from_pdf(pdf).collect(), key=lambda r: r.page_id)
    assert (a.title, a.lang, a.word_count, said(a)) == ("a b.pdf", "en", 3, [("paragraph", "one two"), ("paragraph", "three")])
    assert (b.ok, b.strategy, b.title) == (False, "none", "PDF Document")
    docs = spark.createDataFrame([(1, "a\n\n b  c", "de"), (2, None, None)], "doc_id long, text string, lang string")
    a, b = sorted(from_documents(docs).collect(), key=lambda r: r.page_id)
    assert (said(a), a.lang, a.word_count, b.ok, b.lang) == ([("paragraph", "a"), ("paragraph", "b c")], "de", 3, False, "en")
    chosen = from_selection(spark.createDataFrame([(1, "u", "x " * 11), (2, "u", "x" * 20), (3, "u", None)], "page_id long, url string, selection string"))
    assert {r.page_id: r.ok for r in chosen.collect()} == {1: True, 2: False, 3: False}
    from pyspark.sql import functions as F

    assert [r.x for r in spark.createDataFrame([("a/B.PDF#p",), ("a.pdf/x",)], "u string").select(is_pdf(F.col("u")).alias("x")).collect()] == [True, False]


def test_nodes_are_gone_through_once_for_blocks(spark):
    """Windows and sums over all nodes were computed again for each of the later steps that read blocks: five times in one plan."""
    from lectern.operators.blocks import blocks_from, with_stamps
    from lectern.operators.density import winners

    rows = with_stamps(nodes(spark.createDataFrame([(1, PAGES[1][1])], "page_id long, html string")))
    found = blocks_from(rows, winners(features(rows)).select("page_id", F.lit("density").alias("source"), "c_seq", "c_end"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # One numbers the claims of stamps, and one the stamps that are claimed.
    assert plan.count("Window [") <= 3
    assert "Second one is unclosed" in " ".join(r.text for r in found.collect())
