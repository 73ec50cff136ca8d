"""Extractions of pages: strategies in turn, metadata, and the first that gives blocks.

A selection wins, then the site's adapter, then the article, then the densest container; the last two if they give
LEAST_CHARS characters, else the longer of them, the article if they are equal. A page that gives nothing is a row with its
reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, detect_lang, url_host, word_count
from lectern.operators.adapters import REGISTRY, adapter_of, containers, finished, pieces, signed, whole_text, with_furniture
from lectern.operators.article import articles
from lectern.operators.blocks import blocks_from, gathered, with_stamps
from lectern.operators.custom import PageAdapter, adapted
from lectern.operators.density import article_score, features, winners
from lectern.operators.nodes import attr, has_class, nodes
from lectern.operators.selection import RANGE, selected_blocks
from lectern.operators.sheets import with_sheets
from lectern.plans.storage import stored
from lectern.schema import META
from lectern.sources.tables import MIN_SELECTION, paragraphs

NOTHING = "Nothing readable was found on this page."
#: Longest byline, and how much an article or a dense container must give to be taken at once.
MOST_BYLINE, LEAST_CHARS = 120, 250


def metadata(rows: DataFrame) -> DataFrame:
    """(page_id, meta_title, byline, site, html_lang, content_lang) from node rows."""
    first = lambda value, test: F.min_by(F.when(test, value), F.when(test, F.col("seq")))
    content, said = collapse(attr("content")), lambda test: test & (collapse(attr("content")) != "")
    meta = F.col("tag") == "meta"
    named = lambda key, name: first(content, said(meta & (attr(key) == name)))
    author = (attr("rel") == "author") | ((attr("class") != "") & (has_class("byline") | has_class("author-name"))) | (attr("itemprop") == "author")
    plain = rows.filter(F.col("tag").isin("meta", "html")).groupBy("page_id").agg(
        F.coalesce(named("property", "og:title"), named("name", "twitter:title")).alias("social_title"),
        F.coalesce(named("name", "author"), named("property", "article:author")).alias("author"),
        named("property", "og:site_name").alias("site"),
        first(attr("lang"), F.col("tag") == "html").alias("html_lang"),
        first(content, said(meta & (F.lower(attr("http-equiv")) == "content-language"))).alias("content_lang"),
    )
    kind = F.when(F.col("tag") == "title", "title").when(F.col("tag") == "h1", "h1").when(~F.col("is_text") & (F.col("tag") != "meta") & author, "by")
    picks = rows.withColumn("what", kind).filter("what IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("page_id", "what").orderBy("seq"))).filter("k = 1").select("page_id", "seq", "t_from", "t_to", "what")
    texts = whole_text(rows, picks).groupBy("page_id").agg(*[F.max(F.when(F.col("what") == w, F.nullif("text", F.lit("")))).alias(w) for w in ("title", "h1", "by")])
    both = plain.join(texts, "page_id", "full")
    byline = F.coalesce("author", F.when(F.char_length("by") <= MOST_BYLINE, F.col("by")))
    return both.select("page_id", F.coalesce("social_title", "title", "h1").alias("meta_title"), byline.alias("byline"), "site", "html_lang", "content_lang")


def _charged(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda a, b: a + word_count(b["text"]))


def _chars(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda a, b: a + F.char_length(b["text"]))


def article_wins(article: Column, dense: Column) -> Column:
    """Whether an article of so many characters is read rather than a dense container of so many; null: there is none."""
    a, d = F.coalesce(article, F.lit(-1)), F.coalesce(dense, F.lit(-1))
    return (a >= LEAST_CHARS) | ((a >= 0) & (d < LEAST_CHARS) & (a >= d))


def extract(pages: DataFrame, registry=REGISTRY, reader: bool = True, adapters: Sequence[PageAdapter] = ()) -> DataFrame:
    """Extractions of `pages` (page_id, url, html, and optionally selection, a text, or range, as in operators.selection). The
    markup is parsed once. Without `reader` no
    articles are looked for. `adapters`, which users write, are tried before those of the registry."""
    # Adapters that read nothing only say why; the page goes on to the next.
    readers = [a for a in registry if a.containers or a.pieces]
    mute = [a for a in registry if a not in readers]
    pages = pages.withColumns({"adapter": adapter_of(F.col("url"), readers), "mute": adapter_of(F.col("url"), mute)})
    if "selection" not in pages.columns:
        pages = pages.withColumn("selection", F.lit(None).cast("string"))
    light = pages.drop("html")
    # All later steps read this table, so pages are parsed once.
    parsed = with_sheets(stored(nodes(pages), "parsed"))
    rows = stored(with_stamps(parsed).join(light.select("page_id", "adapter"), "page_id"), "nodes")
    elements = stored(features(rows), "features")
    dense = winners(elements).select("page_id", F.lit("density").alias("source"), "c_seq", "c_end")
    if reader:
        likely = article_score(elements).filter("is_article").select("page_id")
        found = stored(articles(elements.join(likely, "page_id", "left_semi"), rows, LEAST_CHARS), "found_articles")
        # Where the article is the dense container, its blocks are the same, and it wins; they are made once.
        alone = found.groupBy("page_id").agg(F.min("c_seq").alias("c_seq"), F.min("c_end").alias("c_end"), F.count(F.lit(1)).alias("n")).filter("n = 1")
        dense = dense.join(alone, ["page_id", "c_seq", "c_end"], "left_anti").select("page_id", "source", "c_seq", "c_end")
        place = F.row_number().over(Window.partitionBy("page_id").orderBy("c_seq"))
        dense = dense.unionByName(found.select("page_id", F.format_string("article#%06d", place).alias("source"), "c_seq", "c_end"))
    dense = stored(dense, "winners")
    sited = rows.filter("adapter IS NOT NULL")
    if sited.isEmpty():
        found = stored(blocks_from(rows, dense), "blocks")
        content = None
    else:
        parts = stored(containers(sited, registry), "containers")
        found = stored(blocks_from(with_furniture(rows, registry), parts.drop("label").unionByName(dense)), "blocks")
        content = _adapted(found, sited, parts, light, registry).select("page_id", F.col("blocks").alias("adapted"))
    # An article's parts are read one after the other, as one list.
    whole = gathered(found.filter("NOT source LIKE 'adapter%'").withColumn("source", F.split("source", "#")[0]))
    lists = whole.groupBy("page_id").agg(*[F.first(F.when(F.col("source") == name, F.col("blocks")), ignorenulls=True).alias(to) for name, to in (("article", "article"), ("density", "dense"))])
    if content is None:
        content = lists.select("page_id", F.lit(None).cast(lists.schema["dense"].dataType).alias("adapted"))

    if adapters:
        content = content.join(_customs(rows, light, adapters), "page_id", "full").withColumns({"adapted": F.coalesce("own", "adapted"), "named": F.col("own_name")}).drop("own", "own_name")
    else:
        content = content.withColumn("named", F.lit(None).cast("string"))

    selected = collapse(F.coalesce("selection", F.lit("")))
    selection = F.when(F.char_length(selected) > MIN_SELECTION, paragraphs(F.array(selected)))
    if "range" in pages.columns:
        chosen = selected_blocks(rows, light.filter("range IS NOT NULL").select("page_id", F.col("range").cast(RANGE).alias("range")))
        content = content.join(chosen.withColumnRenamed("blocks", "cut_out"), "page_id", "full")
        selection = F.coalesce("cut_out", selection)
    out = light.join(content, "page_id", "left").join(lists, "page_id", "left").join(metadata(rows), "page_id", "left").join(signed(rows, mute), "page_id", "left")
    reads = article_wins(_chars(F.col("article")), _chars(F.col("dense")))
    chosen = F.coalesce(selection, "adapted", F.when(reads, F.col("article")).otherwise(F.col("dense")))
    strategy = F.when(selection.isNotNull(), "selection").when(F.col("adapted").isNotNull(), F.concat(F.lit("adapter:"), F.coalesce("named", "adapter"))).when(reads, "readability").when(F.col("dense").isNotNull(), "density").otherwise("none")
    notes = F.create_map(*[F.lit(x) for a in registry if a.note for x in (a.name, a.note)])
    reason = F.coalesce(*[F.try_element_at(notes, F.col(c)) for c in ("mute", "signed", "adapter")], F.lit(NOTHING))
    host = F.nullif(url_host(F.col("url")), F.lit(""))
    out = out.withColumns({"blocks": chosen, "ok": chosen.isNotNull()})
    return out.select(
        "page_id",
        "url",
        "ok",
        F.coalesce("meta_title", host).alias("title"),
        F.when(F.col("ok"), F.col("byline")).alias("byline"),
        F.coalesce("site", host).alias("site_name"),
        detect_lang(F.coalesce("html_lang", F.lit("")), F.coalesce("content_lang", F.lit(""))).alias("lang"),
        strategy.alias("strategy"),
        F.when(~F.col("ok"), reason).alias("reason"),
        F.coalesce(_charged(F.col("blocks")), F.lit(0)).cast("int").alias("word_count"),
        F.coalesce("blocks", F.array().cast(out.schema["blocks"].dataType)).alias("blocks"),
    )


def _customs(rows: DataFrame, pages: DataFrame, adapters: Sequence[PageAdapter]) -> DataFrame:
    """(page_id, own, own_name): blocks of the pages that users' adapters read, with the ids of elements that have one."""
    none = F.lit(None)
    read = adapted(rows, pages, adapters)
    stamps = rows.filter("stamp IS NOT NULL").select("page_id", "seq", F.concat(F.lit("u"), F.col("stamp").cast("string")).alias("uid"))
    blocks = stored(read.join(stamps, ["page_id", "seq"], "left").withColumn("meta", none.cast(META)), "customs")
    names = blocks.groupBy("page_id").agg(F.first("adapter").alias("own_name"))
    return gathered(blocks).select("page_id", F.col("blocks").alias("own")).join(names, "page_id")


def _adapted(found: DataFrame, sited: DataFrame, parts: DataFrame, pages: DataFrame, registry) -> DataFrame:
    """(page_id, blocks) of the adapters that give more than titles."""
    none = F.lit(None)
    code = F.struct(F.size(F.split("text", "\n")).cast("int").alias("lines"), none.cast("int").alias("rows"), none.cast("int").alias("cols"), none.cast("string").alias("file"), none.cast("array<array<string>>").alias("cells"))
    whole = pieces(sited, registry).withColumns({"uid": none.cast("string"), "meta": F.when(F.col("kind") == "code", code).cast(META), "label": none.cast("string")})
    labels = parts.select("page_id", "source", "label")
    body = found.filter(F.col("source").startswith("adapter")).join(labels, ["page_id", "source"], "left")
    adapted = finished(body.unionByName(whole), pages, sited)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("source", "at"))
    lists = gathered(adapted.withColumn("at", place).withColumn("source", F.lit("adapter")))
    return lists.filter(F.exists("blocks", lambda b: b["kind"] != "heading"))
