"""The container with the densest prose on a page, from sums over subtrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.blocks import SKIP_TAGS, hidden, subtree_sums
from lectern.operators.nodes import SEPARATOR, TEXT, attr
from lectern.operators.selectors import any_of
from lectern.plans.storage import stored

#: Selectors and patterns.
CANDIDATES = ("main", "article", "[role=main]", "[itemprop=articleBody]", ".content", "#content", ".post", ".entry", ".entry-content", ".post-content", ".article-body", ".articleBody", ".markdown-body", ".prose", ".story", "section", "div")
PROSE_TAGS = tuple("p li blockquote pre h1 h2 h3 h4 h5 h6 dd figcaption".split())
POSITIVE = "article|blog|body|chapter|content|docs|entry|hentry|h-entry|main|markdown|page|post|prose|readme|story|text"
NEGATIVE = (
    "(^|[-_ ])(nav|navbar|navigation|menu|sidebar|side|aside|rail|comment|comments|disqus|respond|reply|footer|foot|masthead|header|topbar|breadcrumb|breadcrumbs|"
    "promo|promotion|cookie|cookies|consent|gdpr|banner|share|sharing|social|follow|subscribe|newsletter|signup|related|recommended|recirc|more|popular|trending|"
    "popup|modal|overlay|drawer|dialog|toolbar|pager|pagination|paywall|advert|advertisement|ads|ad|sponsor|sponsored|widget|byline|tags|toc|skip)([-_ ]|$)"
)
STRONG = "articlebody|article-body|article__body|entry-content|post-content|post-body|story-body|markdown-body|rich-text"
UNLIKELY = (
    "(?i)-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|"
    "skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
)
MAYBE = "(?i)and|article|body|column|content|main|shadow"
#: Least characters of a candidate and of prose, most candidates of a page, share of its text that makes a
#: child stand for its parent, and steps down to it.
COMMAS = ",，、؛"
LEAST_CHARS, MOST_CANDIDATES, PROSE_CHARS, HELD, STEPS = 140, 300, 25, 0.92, 8


def features(nodes: DataFrame) -> DataFrame:
    """Elements with sums over their subtrees: all, visible and linked characters, prose, commas, elements."""
    by = ("page_id",)
    text = F.when(F.col("tag") == TEXT, F.char_length("text")).otherwise(0)
    veiled = ~F.col("is_text") & hidden() & ~F.col("tag").isin(*SKIP_TAGS)
    link = F.coalesce((F.col("tag") == "a") & F.map_contains_key("attrs", "href"), F.lit(False))
    # By length, as commas are one character each.
    without = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), COMMAS, F.col("text"))
    commas = F.when(F.col("tag") == TEXT, F.char_length("text") - F.char_length(without)).otherwise(0)
    # Texts are counted before they are sorted, which then goes without them, and without line ends, which nothing counts.
    rows = nodes.filter(F.col("tag") != SEPARATOR).withColumns({"n": text, "n_commas": commas, "text": F.lit(None).cast("string")})
    rows = rows.withColumns({"out": _within(veiled) & (F.col("tag") == TEXT), "linked": _within(link)})
    unseen, in_links = [F.when(F.col(c), F.col("n")).otherwise(0) for c in ("out", "linked")]
    rows = subtree_sums(rows, by, chars=F.col("n"), unseen=unseen, in_links=in_links, commas=F.col("n_commas"), elements=~F.col("is_text"))
    elements = rows.filter("NOT is_text").drop("n", "out", "linked", "n_commas")
    enough = F.col("chars") >= PROSE_CHARS
    # What holds too little to be prose holds none.
    return subtree_sums(elements, by, enough, prose=F.col("tag").isin(*PROSE_TAGS) & enough).withColumns({"visible": F.greatest(F.col("chars") - F.col("unseen"), F.lit(0)), "veiled": F.coalesce(hidden(), F.lit(False))})


def _within(test: Column) -> Column:
    """Whether a node is inside an element of its page with the property."""
    before = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(test, F.col("end"))).over(before), F.lit(0)) > F.col("seq")


def score() -> Column:
    """Of an element with features; -1 if it holds too little."""
    visible, prose = F.col("visible"), F.col("prose")
    links = F.least(F.lit(1.0), F.col("in_links") / visible)
    named = F.lower(F.concat(attr("class"), F.lit(" "), attr("id")))
    weight = F.when(named.rlike(NEGATIVE), -45).otherwise(0) + F.when(named.rlike(POSITIVE), 25).otherwise(0) + F.when(named.rlike(STRONG), 45).otherwise(0) + F.when(attr("itemprop") == "articleBody", 45).otherwise(0)
    bonus = F.when(F.col("tag").isin("main", "article") | (attr("role") == "main"), 35).when(F.col("tag") == "section", 8).otherwise(0)
    s = 12 * prose + 3 * F.least("commas", F.lit(60)) + F.least(visible / 100, F.lit(60.0)) + F.least(visible / (F.col("elements") + 1), F.lit(40.0)) + weight + bonus
    s = s - F.when(prose == 0, 25).otherwise(0) - F.when(links > 0.5, 40).otherwise(0)
    return F.when(visible < LEAST_CHARS, F.lit(-1.0)).otherwise(s * (1 - F.least(links, F.lit(0.95))))


def winners(features: DataFrame) -> DataFrame:
    """(page_id, c_seq, c_end): of elements with features the best container of each page that has one, tightened."""
    page = Window.partitionBy("page_id")
    # Of several bodies, or none, the outermost element that holds the page.
    outer = F.when(F.col("tag") == "body", 0).when(F.col("tag") == "html", 1).otherwise(2)
    rooted = features.withColumn("root", F.min(F.struct(outer.alias("r"), "seq", "end")).over(page))
    elements = rooted.filter((F.col("seq") >= F.col("root.seq")) & (F.col("seq") < F.col("root.end")))
    elements = stored(elements.select("page_id", "seq", "end", "parent", "tag", "attrs", "is_text", "chars", "visible", "in_links", "commas", "elements", "prose", "veiled", (F.col("seq") == F.col("root.seq")).alias("is_root")), "candidates")
    wanted = (any_of(CANDIDATES) & ~F.col("veiled")) | F.col("is_root")
    ranked = elements.filter(wanted & (F.col("chars") >= LEAST_CHARS)).withColumn("k", F.row_number().over(page.orderBy(F.desc("chars"), "seq")))
    scored = ranked.filter(F.col("k") <= MOST_CANDIDATES).withColumn("score", score()).filter("score > 0")
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("seq", "end"), F.struct("score", -F.col("seq"))).alias("best"))

    whole = elements.select("page_id", F.col("seq").alias("parent"), F.col("visible").alias("whole"))
    first = F.row_number().over(Window.partitionBy("page_id", "parent").orderBy(F.desc("visible"), "seq"))
    heavy = elements.filter("NOT veiled AND parent IS NOT NULL").withColumn("k", first).filter("k = 1").join(whole, ["page_id", "parent"])
    heavy = heavy.filter((F.col("whole") >= LEAST_CHARS) & (F.col("visible") >= HELD * F.col("whole")) & ~F.col("tag").isin("p", "pre", "table"))
    down = heavy.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("parent", F.struct("seq", "end")))).alias("down"))
    # From the best, as long as one child holds nearly all, to that child.
    step = lambda at, _: F.coalesce(F.try_element_at("down", at["seq"]), at)
    end = F.when(F.col("down").isNull(), F.col("best")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("best"), step))
    return best.join(down, "page_id", "left").select("page_id", end.alias("c")).select("page_id", F.col("c.seq").alias("c_seq"), F.col("c.end").alias("c_end"))


def article_score(features: DataFrame) -> DataFrame:
    """(page_id, score, is_article): whether a page looks like an article, by the roots of its prose's lengths."""
    nodes = features
    named = F.concat(attr("class"), F.lit(" "), attr("id"))
    breaks = nodes.filter("tag = 'br'").select("page_id", F.col("parent").alias("seq")).distinct().withColumn("breaks", F.lit(True))
    rows = features.withColumn("listed", _within(F.col("tag") == "li")).join(breaks, ["page_id", "seq"], "left")
    prose = rows.filter((F.col("tag").isin("p", "pre", "article") | ((F.col("tag") == "div") & F.col("breaks"))) & ~F.col("veiled") & (F.col("chars") >= LEAST_CHARS) & ~(named.rlike(UNLIKELY) & ~named.rlike(MAYBE)))
    sums = prose.filter("tag <> 'p' OR NOT listed").groupBy("page_id").agg(F.sum(F.sqrt(F.col("chars") - LEAST_CHARS)).alias("score"))
    return nodes.select("page_id").distinct().join(sums, "page_id", "left").select("page_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.col("score") > 20, F.lit(False)).alias("is_article"))
