"""Selectors against a plain matcher on random trees."""

import random

import pytest

from lectern.operators.nodes import nodes
from lectern.operators.selectors import parse, ranked, selected, split_list

SELECTORS = (
    ".thumb .magnify", "table.wikitable + .reflist", ".NavContent .translations", "div > p", "div > div > .a", ".a ~ .b", "p:first-child", "div:not(.a)", "div:not(.a) > p.b", "* + *",
    ".a .b > .a", "[data-x]", "[data-x=one]", "[data-x^='on']", "[data-x$=e]", '[data-x*="n"]', "[class~=b]", "#i3", "div .a ~ p", "p.a.b", "body > * > *", ".b + .b + .b", ".a .a .a",
)


def page(seed):
    draw = random.Random(seed)
    count = iter(range(10**6))

    def part(depth):
        tag = draw.choice(["div", "div", "p", "table", "span", "section"])
        names = draw.sample(["a", "b", "thumb", "magnify", "wikitable", "reflist", "NavContent", "translations"], draw.randint(0, 3))
        attrs = (f' class="{" ".join(names)}"' if names else "") + (f' data-x="{draw.choice(["one", "two", "none"])}"' if draw.random() < 0.3 else "") + f' id="i{next(count)}"'
        inner = "".join(part(depth + 1) for _ in range(draw.randint(0, 4))) if depth < 5 and tag != "p" else "x"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return f"<body>{part(0)}text{part(0)}</body>"


def simple(r, compound):
    """One compound, read character by character."""
    at = 0
    while at < len(compound):
        if compound.startswith(":first-child", at):
            at += len(":first-child")
            if r.before is not None:
                return False
        elif compound.startswith(":not(", at):
            end = compound.index(")", at)
            if simple(r, compound[at + 5 : end]):
                return False
            at = end + 1
        elif compound[at] == "[":
            end = compound.index("]", at)
            name, _, want = compound[at + 1 : end].replace('"', "").replace("'", "").partition("=")
            op = name[-1] if name[-1] in "^$*~" else ""
            name = name.rstrip("^$*~")
            value = r.attrs.get(name)
            if value is None:
                return False
            if "=" in compound[at:end] and not {"": value == want, "^": value.startswith(want), "$": value.endswith(want), "*": want in value, "~": want in value.split()}[op]:
                return False
            at = end + 1
        else:
            mark = compound[at] if compound[at] in ".#" else ""
            end = at + len(mark)
            while end < len(compound) and (compound[end].isalnum() or compound[end] in "-_*"):
                end += 1
            word = compound[at + len(mark) : end]
            if mark == "." and word not in r.attrs.get("class", "").split() or mark == "#" and r.attrs.get("id") != word or not mark and word not in ("*", r.tag):
                return False
            at = end
    return True


def matches(r, chain, by, kids):
    """From the last compound to the first."""
    (joint, compound), rest = chain[-1], chain[:-1]
    if not simple(r, compound):
        return False
    if not rest:
        return True
    if joint in "+~":
        elder = [x for x in kids.get(r.parent, []) if x.seq < r.seq]
        return any(matches(x, rest, by, kids) for x in (elder[-1:] if joint == "+" else elder))
    up = r.parent
    while up is not None:
        if matches(by[up], rest, by, kids):
            return True
        if joint == ">":
            return False
        up = by[up].parent
    return False


@pytest.fixture(scope="module")
def trees(spark):
    table = nodes(spark.createDataFrame([(k, page(k)) for k in range(25)], "page_id long, html string"))
    rows = [r for r in table.collect() if not r.is_text]
    return table, rows


@pytest.mark.parametrize("selector", SELECTORS)
def test_like_a_matcher(trees, selector):
    table, rows = trees
    want = set()
    for k in {r.page_id for r in rows}:
        own = sorted((r for r in rows if r.page_id == k), key=lambda r: r.seq)
        by, kids = {r.seq: r for r in own}, {}
        for r in own:
            kids.setdefault(r.parent, []).append(r)
        want |= {(k, r.seq) for r in own if matches(r, parse(selector), by, kids)}
    got = [(r.page_id, r.seq) for r in selected(table, selector).collect()]
    assert sorted(got) == sorted(want) and (want or selector == "#i3")


def test_first_choice_wins(spark, trees):
    from pyspark.sql import functions as F

    table, _ = trees
    found = ranked(table.withColumn("adapter", F.lit("x")), {"x": (".a > .b", "p", "div, table"), "y": ("span",)}).collect()
    assert {r.rank for r in found} == {0, 1, 2, 3} and {r.adapter for r in found} == {"x"}


def test_lists_and_faults():
    assert split_list(["a, b", "[x='1,2'] c", "p:not(.a)"]) == ["a", "b", "[x='1,2'] c", "p:not(.a)"]
    assert parse("a>b  +  c d") == [("", "a"), (">", "b"), ("+", "c"), (" ", "d")]
    for wrong in ("", "> a", "a >", "a > > b", "a:hover(", "["):
        with pytest.raises(ValueError):
            parse(wrong)


def test_deep_and_wide_pages(spark):
    """100,000 cells, and 50,000 elements one in the other: time and rows grow with the markup alone."""
    import time

    cells = "<table>" + "".join(f"<tr><td>c{k}</td><td>d</td></tr>" for k in range(50_000)) + "</table>"
    deep = "<div>" * 50_000 + "x"
    began = time.time()
    rows = nodes(spark.createDataFrame([(1, cells), (2, deep)], "page_id long, html string"))
    got = {r.page_id: (r.n, r.most) for r in rows.groupBy("page_id").agg({"*": "count", "near": "max"}).withColumnsRenamed({"count(1)": "n", "max(near)": "most"}).collect()}
    assert got[1][0] > 300_000 and got[2][0] > 100_000 and len(got[2][1]) <= 8
    assert time.time() - began < 60
