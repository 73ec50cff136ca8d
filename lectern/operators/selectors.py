"""Style sheets' selectors over node rows.

What a selector says of an element alone is a condition on its row. What it says of others is a join of the rows that match
so far: an equi-join on the parent or on the element before, and for descendants a running maximum of interval ends over
those few rows. So a selector of k compounds is k filters of one pass each and k - 1 joins of what they let by.

Understood: tag, *, .class, #id, [a], [a=v], [a^=v], [a$=v], [a*=v], [a~=v], :not(compound), :first-child; the combinators
descendant, >, + and ~; lists by commas. Anything else is a ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.nodes import attr, has_class

_NAME = r"[\w-]+"
_SIMPLE = re.compile(
    rf"""\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[^"'\]\s]*))\s*)?\]"""
    rf"""|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})|:not\((?P<none>[^()]*)\)|(?P<first>:first-child)|(?P<tag>{_NAME}|\*)"""
)
_PART = re.compile(r"""(?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+|\s*[>+~]\s*|\s+""")


def split_list(selectors: str | Iterable[str]) -> list[str]:
    """Selectors without commas."""
    given = [selectors] if isinstance(selectors, str) else [*selectors]
    return [s.strip() for one in given for s in re.split(r",(?![^\[]*\])(?![^(]*\))", one)]


def parse(selector: str) -> list[tuple[str, str]]:
    """(combinator, compound) pairs; the first combinator is ''."""
    out: list[tuple[str, str]] = []
    joint, at = "", 0
    text = selector.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"not a selector: {selector!r}")
        at, part = m.end(), m[0]
        if part.strip() in (">", "+", "~", ""):
            if joint or not out:
                raise ValueError(f"not a selector: {selector!r}")
            joint = part.strip() or " "
        else:
            out.append((joint, part))
            joint = ""
    if joint or not out:
        raise ValueError(f"not a selector: {selector!r}")
    return out


def css(compound: str) -> Column:
    """Whether a node is an element that a compound selector describes; never null."""
    out, at = ~F.col("is_text"), 0
    while at < len(compound):
        m = _SIMPLE.match(compound, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"not a selector: {compound!r}")
        at = m.end()
        if m["tag"]:
            test = F.lit(True) if m["tag"] == "*" else F.col("tag") == m["tag"].lower()
        elif m["cls"]:
            test = has_class(m["cls"])
        elif m["id"]:
            test = attr("id") == m["id"]
        elif m["none"] is not None:
            test = ~css(m["none"].strip())
        elif m["first"]:
            test = F.col("before").isNull()
        elif m["op"] is None:
            test = F.map_contains_key("attrs", m["attr"])
        else:
            value, want = attr(m["attr"]), m["q"] or m["s"] or m["v"] or ""
            test = {"=": value == want, "^=": value.startswith(want), "$=": value.endswith(want), "*=": value.contains(want), "~=": F.array_contains(F.split(value, r"\s+"), want)}[m["op"]]
        out = out & test
    return F.coalesce(out, F.lit(False))


def any_of(compounds: Iterable[str]) -> Column:
    """Whether a node matches any compound selector; those of one class, id or tag are looked up together."""
    lone: dict[str, list[str]] = {"class": [], "id": [], "tag": []}
    rest = []
    for s in compounds:
        kind = "class" if re.fullmatch(rf"\.{_NAME}", s) else "id" if re.fullmatch(rf"#{_NAME}", s) else "tag" if re.fullmatch(_NAME, s) else None
        if kind is None:
            rest.append(s)
        else:
            lone[kind].append(s.lstrip(".#"))
    out = F.lit(False)
    if lone["class"]:
        out = out | F.arrays_overlap(F.split(attr("class"), r"\s+"), F.array(*map(F.lit, lone["class"])))
    if lone["id"]:
        out = out | attr("id").isin(*lone["id"])
    if lone["tag"]:
        out = out | F.col("tag").isin(*[t.lower() for t in lone["tag"]])
    for s in rest:
        out = out | css(s)
    return F.coalesce(~F.col("is_text") & out, F.lit(False))


def _step(found: DataFrame, joint: str, rows: DataFrame) -> DataFrame:
    """Of `rows` those that stand to one of `found` as a combinator says."""
    if joint == ">":
        return rows.join(found.select("page_id", F.col("seq").alias("parent")), ["page_id", "parent"], "left_semi")
    if joint == "+":
        return rows.join(found.select("page_id", F.col("seq").alias("before")), ["page_id", "before"], "left_semi")
    if joint == "~":
        first = found.groupBy("page_id", F.coalesce("parent", F.lit(-1)).alias("__parent")).agg(F.min("seq").alias("__first"))
        later = rows.withColumn("__parent", F.coalesce("parent", F.lit(-1))).join(first, ["page_id", "__parent"])
        return later.filter(F.col("seq") > F.col("__first")).drop("__parent", "__first")
    both = rows.withColumn("__from", F.lit(False)).unionByName(found.withColumn("__from", F.lit(True)))
    earlier = Window.partitionBy("page_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("__from"), F.col("end"))).over(earlier)
    return both.withColumn("__reach", reach).filter((~F.col("__from")) & (F.col("__reach") > F.col("seq"))).drop("__from", "__reach")


KEPT = ("page_id", "seq", "end", "parent", "before", "t_from", "t_to")


def selected(nodes: DataFrame, selector: str, where: Column | None = None) -> DataFrame:
    """KEPT columns of the elements that one selector describes; `where` keeps pages, such as those of one site."""
    rows = nodes if where is None else nodes.filter(where)
    (_, first), *rest = parse(selector)
    found = rows.filter(css(first)).select(*KEPT)
    for joint, compound in rest:
        found = _step(found, joint, rows.filter(css(compound)).select(*KEPT)).select(*KEPT)
    return found


def ranked(nodes: DataFrame, choices: Mapping[str, Iterable[str]]) -> DataFrame:
    """(adapter, rank, KEPT) of elements by the place of the selectors of their page's adapter that they match: of lone
    compounds the first, of each other selector all."""
    alone, joined = [], []
    for name, selectors in choices.items():
        for k, s in enumerate(split_list(selectors)):
            if len(parse(s)) == 1:
                alone.append((name, k, s))
            else:
                joined.append(selected(nodes, s, F.col("adapter") == name).withColumns({"adapter": F.lit(name), "rank": F.lit(k)}))
    parts = joined
    if alone:
        place = F.coalesce(*[F.when((F.col("adapter") == name) & css(s), k) for name, k, s in alone])
        parts = [nodes.withColumn("rank", place).filter("rank IS NOT NULL").select(*KEPT, "adapter", "rank"), *joined]
    return reduce(DataFrame.unionByName, parts)


def marked(nodes: DataFrame, choices: Mapping[str, Iterable[str]], name: str) -> DataFrame:
    """`nodes` with the boolean `name`: whether a selector of their page's adapter describes them."""
    alone = F.lit(False)
    joined = []
    for adapter, selectors in choices.items():
        parts = split_list(selectors)
        lone = [s for s in parts if len(parse(s)) == 1]
        alone = alone | ((F.col("adapter") == adapter) & any_of(lone)) if lone else alone
        joined += [selected(nodes, s, F.col("adapter") == adapter) for s in parts if s not in lone]
    out = nodes.withColumn(name, F.coalesce(alone, F.lit(False)))
    if joined:
        hits = reduce(DataFrame.unionByName, joined).select("page_id", "seq").distinct().withColumn("__hit", F.lit(True))
        out = out.join(hits, ["page_id", "seq"], "left").withColumn(name, F.col(name) | F.coalesce("__hit", F.lit(False))).drop("__hit")
    return out


__all__ = ["any_of", "css", "marked", "parse", "ranked", "selected", "split_list"]
