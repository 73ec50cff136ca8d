"""The article of a page: prose gives its score to the elements around it, and the best of these takes in its neighbours.

A piece of prose scores by its length and commas. It gives that to up to LEVELS elements above it, less the farther they
are: whole to its parent, half to the next, then a third of that a level. An element's own kind and name add to what it
got, and links take from it in proportion. The best element is joined by those of its siblings that score enough, share its
class, or are prose by themselves. What is named like furniture is passed over at first; where that leaves too little, it
counts again.

Sums are of whole numbers (shares of SHARE), so they don't depend on the order of adding. Equal scores go to the element
that comes first. Pages without prose have no article. Texts are counted as far as they are not hidden. Advertisements give
nothing and join nothing, unless a page has no other prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.blocks import SKIP_TAGS, subtree_sums
from lectern.operators.density import MAYBE, UNLIKELY, _within
from lectern.operators.nodes import attr
from lectern.plans.storage import stored

#: Tags of prose, of blocks that make a div no prose, points by tag and name, roles and bounds.
PROSE_TAGS = ("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre")
BLOCK_TAGS = ("blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")
POINTS = {5: ("div",), 3: ("pre", "td", "blockquote"), -3: ("address", "ol", "ul", "dl", "dd", "dt", "li", "form"), -5: ("h1", "h2", "h3", "h4", "h5", "h6", "th")}
ROLES = ("menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog")
POSITIVE = "(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
NEGATIVE = "(?i)-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget"
ADVERT = "(?i)(^|[-_ ])(ad|ads|advert|advertisement|sponsor|sponsored)([-_ ]|$)"
WEIGHT, LEAST_PROSE, LEVELS, LEAST_SIBLING, SIBLING_SHARE = 25, 25, 5, 10, 0.2
LONG_SIBLING, LINKS_OF_LONG = 80, 0.25
#: What each level above gets, in parts of SHARE.
SHARE = 36
GIVEN = (SHARE, SHARE // 2, SHARE // 6, SHARE // 9, SHARE // 12)


def name_weight() -> Column:
    """What an element's class and id tell, each by itself."""
    of = lambda text: F.when(text.rlike(NEGATIVE), -WEIGHT).otherwise(0) + F.when(text.rlike(POSITIVE), WEIGHT).otherwise(0)
    return of(attr("class")) + of(attr("id"))


def tag_points() -> Column:
    out = F.lit(0)
    for points, tags in POINTS.items():
        out = F.when(F.col("tag").isin(*tags), points).otherwise(out)
    return out


def link_share() -> Column:
    return F.when(F.col("visible") > 0, F.least(F.col("in_links") / F.col("visible"), F.lit(1.0))).otherwise(0.0)


def weighed(features: DataFrame) -> DataFrame:
    """Elements with features and what else scoring needs, stored: blocks below, and out and ad: furniture and advertisements by
    their names, at or above it."""
    named = F.concat(attr("class"), F.lit(" "), attr("id"))
    furniture = (named.rlike(UNLIKELY) & ~named.rlike(MAYBE) & ~F.col("tag").isin("body", "html", "a", "table", "code")) | attr("role").isin(*ROLES)
    advert = named.rlike(ADVERT) & ~named.rlike(MAYBE) & ~F.col("tag").isin("body", "html")
    dead = F.col("veiled") | F.col("tag").isin(*SKIP_TAGS)
    # Blocks tell which divs are prose, and are counted below these only.
    rows = subtree_sums(features, ("page_id",), F.col("tag") == "div", blocks=F.col("tag").isin(*BLOCK_TAGS))
    rows = rows.withColumns({"gone": dead | _within(dead), "out": furniture | _within(furniture), "ad": advert | _within(advert)}).filter("NOT gone")
    ends = F.coalesce(attr("class"), F.lit(""))
    return stored(rows.select("page_id", "seq", "end", "parent", "near", "tag", "visible", "in_links", "commas", "blocks", "out", "ad", "t_from", "t_to", ends.alias("class"), name_weight().alias("weight"), tag_points().alias("points"), link_share().alias("links")), "weighed")


def scored(rows: DataFrame) -> DataFrame:
    """(page_id, seq, end, parent, class, ad, score) of the elements that got anything."""
    prose = rows.filter((F.col("tag").isin(*PROSE_TAGS) | ((F.col("tag") == "div") & (F.col("blocks") == 0))) & (F.col("visible") >= LEAST_PROSE))
    prose = prose.withColumn("only_ads", F.min("ad").over(Window.partitionBy("page_id"))).filter("NOT ad OR only_ads")
    worth = 1 + F.col("commas") + F.least(F.floor(F.col("visible") / 100), F.lit(3))
    above = F.slice(F.reverse("near"), 2, LEVELS)
    share = F.get(F.array(*map(F.lit, GIVEN)), F.col("level"))
    gifts = prose.select("page_id", worth.alias("worth"), F.posexplode(above).alias("level", "seq"))
    sums = gifts.groupBy("page_id", "seq").agg(F.sum(F.col("worth") * share).alias("given"))
    score = (F.col("given") / SHARE + F.col("points") + F.col("weight")) * (1 - F.col("links"))
    return rows.join(sums, ["page_id", "seq"]).select("page_id", "seq", "end", "parent", "class", "ad", score.alias("score"))


def joined(rows: DataFrame, scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, c_seq, c_end): of each page the best element and the siblings that join it."""
    best = scores.groupBy("page_id").agg(F.max_by(F.struct("seq", "parent", "class", "ad", "score"), F.struct("score", -F.col("seq"))).alias("best"))
    near = rows.join(best, "page_id").filter(F.col("parent").eqNullSafe(F.col("best.parent")) & (~F.col("ad") | F.col("best.ad")))
    near = near.join(scores.select("page_id", "seq", "score"), ["page_id", "seq"], "left")
    bound = F.greatest(F.lit(float(LEAST_SIBLING)), F.col("best.score") * SIBLING_SHARE)
    alike = F.when((F.col("class") != "") & (F.col("class") == F.col("best.class")), F.col("best.score") * SIBLING_SHARE).otherwise(0.0)
    # Short paragraphs join if they hold a sentence; their texts are fetched for them alone.
    short = near.filter((F.col("tag") == "p") & (F.col("visible") > 0) & (F.col("visible") < LONG_SIBLING) & (F.col("in_links") == 0))
    from lectern.operators.adapters import whole_text

    said = whole_text(nodes, short.select("page_id", "seq", "t_from", "t_to")).filter(F.col("text").rlike(r"\.( |$)")).select("page_id", "seq", F.lit(True).alias("sentence"))
    own = (F.col("tag") == "p") & (F.col("visible") >= LONG_SIBLING) & (F.col("links") < LINKS_OF_LONG)
    takes = (F.col("seq") == F.col("best.seq")) | (F.col("score") + alike >= bound) | own | F.col("sentence")
    found = near.join(said, ["page_id", "seq"], "left").filter(F.coalesce(takes, F.lit(False)))
    return found.select("page_id", F.col("seq").alias("c_seq"), F.col("end").alias("c_end"), "visible")


def articles(features: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(page_id, c_seq, c_end) of the pages of elements with features: what is named like furniture stays out where the rest has `least`
    characters, and counts where it has not."""
    rows = weighed(features)
    strict, loose = rows.filter("NOT out"), rows
    first = stored(joined(strict, scored(strict), nodes), "articles")
    enough = first.groupBy("page_id").agg(F.sum("visible").alias("n")).filter(F.col("n") >= least).select("page_id")
    rest = loose.join(enough, "page_id", "left_anti")
    again = joined(rest, scored(rest), nodes)
    return first.join(enough, "page_id", "left_semi").unionByName(again).select("page_id", "c_seq", "c_end")


__all__ = ["articles", "joined", "scored", "weighed"]
