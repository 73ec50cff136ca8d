"""The article of a page against a direct computation over a tree, and the choice between it and the densest container."""

import random
import re
from fractions import Fraction

import pytest

from lectern.operators import article as A
from lectern.operators.density import features
from lectern.operators.extract import LEAST_CHARS, article_wins, extract
from lectern.operators.nodes import nodes

WORDS = "river, boat stone wind. light road, under green hill quiet".split()


def page(seed):
    draw = random.Random(seed)
    classes = ["", "", "", "content", "sidebar", "post body", "promo", "comment main", "x"]

    def part(depth):
        tag = draw.choice(["div", "div", "section", "p", "ul", "td", "h2", "pre", "span"] if depth < 5 else ["p", "p", "h3", "pre"])
        name = f' class="{draw.choice(classes)}"' if draw.random() < 0.6 else ""
        if tag in ("p", "h2", "h3", "pre", "td", "span") or draw.random() < 0.15:
            inner = " ".join(draw.choices(WORDS, k=draw.randint(1, 60)))
            if draw.random() < 0.3:
                inner += f' <a href="x">{" ".join(draw.choices(WORDS, k=draw.randint(1, 20)))}</a>'
        else:
            inner = "".join(part(depth + 1) for _ in range(draw.randint(1, 5)))
        return f"<{tag}{name}>{inner}</{tag}>"

    return f"<html><body>{''.join(part(0) for _ in range(7))}</body></html>"


class Element:
    def __init__(self, row):
        self.row, self.up, self.below = row, None, []

    def all(self):
        for c in self.below:
            yield c
            yield from c.all()


def plain(rows):
    """(seq -> score of elements that got anything, best, joined) by walking a tree."""
    elements = {r.seq: Element(r) for r in rows if not r.is_text}
    for e in elements.values():
        if e.row.parent is not None:
            e.up = elements[e.row.parent]
            e.up.below.append(e)

    def text(e, links=False):
        spans = [x for x in (e, *e.all()) if x.row.tag == "a" and "href" in x.row.attrs]
        pieces = [r for r in rows if r.tag == "#text" and e.row.seq < r.seq < e.row.end]
        return "".join(r.text for r in pieces if not links or any(s.row.seq < r.seq < s.row.end for s in spans))

    def name(e):
        return e.row.attrs.get("class", ""), e.row.attrs.get("id", "")

    def furniture(e):
        while e:
            both = " ".join(name(e))
            if re.search(A.UNLIKELY, both) and not re.search(A.MAYBE, both) and e.row.tag not in ("body", "html", "a", "table", "code"):
                return True
            e = e.up
        return False

    def run(everything):
        use = {k: e for k, e in elements.items() if everything or not furniture(e)}
        given = {}
        for e in use.values():
            own = text(e)
            prose = e.row.tag in A.PROSE_TAGS or (e.row.tag == "div" and not any(c.row.tag in A.BLOCK_TAGS for c in e.all()))
            if not prose or len(own) < 25:
                continue
            worth, up = 1 + len(re.findall("[,，、؛]", own)) + min(len(own) // 100, 3), e.up
            for level in range(5):
                if not up:
                    break
                given[up.row.seq] = given.get(up.row.seq, 0) + Fraction(worth, (1, 2, 6, 9, 12)[level])
                up = up.up
        scores = {}
        for k, got in given.items():
            if k in use:
                e = use[k]
                points = next((p for p, tags in A.POINTS.items() if e.row.tag in tags), 0)
                weight = sum(25 * (bool(re.search(A.POSITIVE, n)) - bool(re.search(A.NEGATIVE, n))) for n in name(e))
                size = len(text(e))
                scores[k] = (float(got) + points + weight) * (1 - (len(text(e, True)) / size if size else 0))
        if not scores:
            return scores, []
        best = max(scores, key=lambda k: (scores[k], -k))
        top, taken = elements[best], []
        for e in [x for x in use.values() if x.up is top.up]:
            size, links = len(text(e)), len(text(e, True))
            alike = scores[best] * 0.2 if name(e)[0] and name(e)[0] == name(top)[0] else 0
            bound = max(10, scores[best] * 0.2)
            if e is top or (e.row.seq in scores and scores[e.row.seq] + alike >= bound):
                taken.append(e)
            elif e.row.tag == "p" and ((size >= 80 and links / size < 0.25) or (0 < size < 80 and not links and re.search(r"\.( |$)", " ".join(text(e).split())))):
                taken.append(e)
        return scores, taken

    strict = run(False)
    if sum(len(text(e)) for e in strict[1]) >= LEAST_CHARS:
        return strict[0], [e.row.seq for e in strict[1]]
    loose = run(True)
    return strict[0], [e.row.seq for e in loose[1]]


def test_like_a_tree(spark):
    pages = spark.createDataFrame([(k, page(k)) for k in range(40)], "page_id long, html string")
    table = nodes(pages)
    feats = features(table)
    rows = {}
    for r in table.collect():
        rows.setdefault(r.page_id, []).append(r)
    scores, found = {}, {}
    for r in A.scored(A.weighed(feats).filter("NOT out")).collect():
        scores.setdefault(r.page_id, {})[r.seq] = r.score
    for r in A.articles(feats, table, LEAST_CHARS).collect():
        found.setdefault(r.page_id, []).append(r.c_seq)
    sizes = set()
    for k, own in rows.items():
        want, taken = plain(sorted(own, key=lambda r: r.seq))
        assert scores.get(k, {}) == pytest.approx(want), k
        assert sorted(found.get(k, [])) == sorted(taken), k
        sizes.add(len(taken))
    assert {1, 2} <= sizes and max(sizes) > 2


def prose(n, place="river"):
    """A text of n characters."""
    return (f"all quiet by the {place}, and more of it. " * (n // 30 + 1))[: n - 1] + "."


@pytest.mark.parametrize(("article", "dense", "wins"), [(250, 900, True), (249, 900, False), (249, 250, False), (249, 249, True), (100, 99, True), (99, 100, False), (None, 5, False), (5, None, True), (None, None, False), (250, None, True), (0, 0, True)])
def test_gate_and_ties(spark, article, dense, wins):
    """From LEAST_CHARS on the article is taken at once; below that the longer one, and the article of equal ones."""
    row = spark.createDataFrame([(article, dense)], "a int, d int")
    assert row.select(article_wins(row.a, row.d).alias("x")).first().x is wins


def test_strategies(spark):
    """An article in a page; prose that no article is made of, as it is short or in lists; a page without either."""
    pages = [
        f"<body><div class='post'><p>{prose(300)}</p><p>{prose(700, 'lake')}</p></div></body>",
        f"<body><p>{prose(200)}</p></body>",
        f"<body><ul>{f'<li><p>{prose(700)}</p></li>' * 2}</ul></body>",
        f"<body><pre style='display:none'>{prose(900)}</pre><p>short</p></body>",
    ]
    rows = extract(spark.createDataFrame([(k, "https://p.example/", h) for k, h in enumerate(pages)], "page_id long, url string, html string")).collect()
    got = {r.page_id: (r.strategy, sum(len(b.text) for b in r.blocks)) for r in rows}
    assert got == {0: ("readability", 1000), 1: ("density", 200), 2: ("density", 700), 3: ("none", 0)}


def test_without_the_reader(spark):
    html = f"<body><article><p>{prose(900)}</p></article></body>"
    df = spark.createDataFrame([(1, "https://p.example/", html)], "page_id long, url string, html string")
    assert extract(df, reader=False).first().strategy == "density"


def test_an_advertisement_does_not_outweigh_a_short_article(spark):
    """An advertisement of many commas gave the body more than the article got, and was read."""
    said = "One long line of prose without any stop that goes on and on for as long as it takes to be an article " * 6
    html = f'<html><body><div class="ad">Buy this, and that, or those, now, here, cheap, today, please.</div><article><h1>A page</h1><p>{said}</p></article></body></html>'
    only = f'<html><body><div class="ad"><p>{said}</p></div></body></html>'
    rows = extract(spark.createDataFrame([(1, "https://x.example/", html), (2, "https://y.example/", only)], "page_id long, url string, html string")).collect()
    texts = {r.page_id: [b.text for b in r.blocks] for r in rows}
    assert texts == {1: ["A page", said.strip()], 2: [said.strip()]}
