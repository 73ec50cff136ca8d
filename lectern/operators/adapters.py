"""Pages of sites with a known build: where their text is, what of it is furniture, and what is put around it.

An adapter is data: domains, ordered selectors of the container, selectors of furniture, and a few switches. All pages of
all adapters go through one plan. Of a site's several parts, such as a question and its answers, each is a container.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, host_matches
from lectern.operators.nodes import TEXT, attr, has_class
from lectern.operators.selectors import css, marked, ranked, selected, split_list
from lectern.plans.storage import stored


@dataclass(frozen=True)
class Adapter:
    name: str
    domains: tuple[str, ...]
    containers: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    #: Elements read whole, in page order: (selector, kind, level, pattern to cut, text before).
    pieces: tuple[tuple[str, str, int | None, str, str], ...] = ()
    path: str = ""
    note: str = ""
    #: Where the container that is found isn't it but its nearest ancestor with a tag: (selector, tag).
    climb: tuple[str, str] | None = None
    #: Elements that show that a page is the adapter's, whatever its address.
    signs: tuple[str, ...] = ()


# Domains and selectors of the sites' pages.
WIKI = Adapter(
    "wikipedia",
    ("wikipedia.org", "wiktionary.org", "wikimedia.org", "wikisource.org", "wikibooks.org", "wikiquote.org", "wikivoyage.org"),
    ("#mw-content-text .mw-parser-output", ".mw-parser-output", "#mw-content-text", "#bodyContent"),
    tuple(
        ".infobox .infobox_v2 .infobox-full-data .sidebar .vertical-navbox .navbox .navbox-inner .navbox-styles .nomobile .reflist .references .reference .refbegin .mw-references-wrap"
        " .mw-editsection .mw-jump-link .mw-empty-elt .mw-cite-backlink #coordinates .geo-inline .hatnote .dablink .rellink #toc .toc .toclimit-2 .toclimit-3 .sidebar-toc .vector-toc"
        " #catlinks .catlinks .printfooter .sistersitebox .side-box .metadata .ambox .mbox-small .plainlinks .noprint .shortdescription .mw-kartographer-maplink .gallery .mw-halign-right"
        " .portalbox .portal .stub .asbox .succession-box .mw-collapsible.mw-collapsed .NavFrame .mw-authority-control sup.reference .nyms .citation-whole .ib-content".split()
    )
    + (".thumb .magnify", "table.wikitable + .reflist", ".NavContent .translations"),
    pieces=((".thumbcaption", "figure", None, "", ""), ("figcaption", "figure", None, "", "")),
)
WIKI_STOP = tuple("references reference notes notes_and_references footnotes citations sources bibliography works_cited external_links see_also further_reading related_pages further_information literature anagrams references_2 further_reading_2".split())
DOCS = Adapter("google-docs", ("docs.google.com",), (".doc-content", "#contents"), pieces=((".kix-paragraphrenderer", "paragraph", None, "", ""),), note="This document is drawn on a canvas, so its text can't be reached.")
NOTION = Adapter(
    "notion",
    ("notion.so", "notion.site", "notion.com"),
    titles=("[placeholder=Untitled]", ".notion-title", "h1.notion-page-title-text"),
    pieces=(
        ("[class*=notion-sub_sub_header-block]", "heading", 3, "", ""),
        ("[class*=notion-sub_header-block]", "heading", 2, "", ""),
        ("[class*=notion-header-block]", "heading", 1, "", ""),
        ("[class*=notion-quote-block]", "quote", None, "", ""),
        ("[class*=notion-code-block]", "code", None, "", ""),
        ("[class*=notion-bulleted_list-block]", "list-item", None, "", ""),
        ("[class*=notion-numbered_list-block]", "list-item", None, "", ""),
        ("[class*=notion-to_do-block]", "list-item", None, "", ""),
        ("[class*=notion-toggle-block]", "list-item", None, "", ""),
        ("[class*=notion-table_row-block]", "table", None, "", ""),
        ("[class*=notion-equation-block]", "math", None, "", ""),
        ("[class*=notion-callout-block]", "paragraph", None, "", ""),
        ("[class*=notion-text-block]", "paragraph", None, "", ""),
    ),
)
GITHUB = Adapter("github", ("github.com",), ("article.markdown-body", "#readme article", ".markdown-body"), (".anchor", ".octicon"), pieces=(("#read-only-cursor-text-area", "code", None, "", ""), ("textarea.react-blob-textarea", "code", None, "", "")))
STACK = Adapter(
    "stack-exchange",
    ("stackoverflow.com", "stackexchange.com", "superuser.com", "serverfault.com", "askubuntu.com", "mathoverflow.net", "stackapps.com", "answers.microsoft.com"),
    ("#question .s-prose", "#question .post-text", ".question .s-prose"),
    tuple(
        ".comments .comments-list .js-comments-container .comment .js-voting-container .votecell .vote .js-vote-count .user-info .user-details .post-signature .signature .post-menu .js-post-menu .d-none"
        " .js-share-link .post-taglist .js-post-tag-list-wrapper .tags .bounty-notification .question-status .js-saves-btn .mt24.mb12 .js-add-link .reduce-and-enhance .wmd-preview".split()
    ),
    ("#question-header h1", "h1[itemprop=name]", ".question-hyperlink", "h1"),
)
ARXIV = Adapter(
    "arxiv",
    ("arxiv.org",),
    pieces=(("h1.title", "heading", 1, r"(?i)^title:\s*", ""), (".authors", "paragraph", None, r"(?i)^authors?:\s*", "Authors: "), ("blockquote.abstract", "paragraph", None, r"(?i)^abstract:\s*", "")),
    path="/abs/",
)
BLOG = Adapter(
    "medium-substack",
    ("medium.com", "substack.com", "towardsdatascience.com"),
    ("article section .pw-post-body-paragraph", "article > div > section", "article section", ".postArticle-content", ".available-content .body.markup", ".post .body.markup", ".available-content", ".single-post .body", "article"),
    (
        *".pw-multi-vote-count .pw-multi-vote-icon .js-postMetaLockup .postArticle-readMore .js-postShareWidget .overlay .speechify-ignore .subscription-widget .subscription-widget-wrap .subscribe-widget .subscribe-footer .paywall .paywall-cta .paywall-jump .post-ufi .post-footer .comments-section .button-wrapper".split(),
        *".share-dialog .podcast-player .captioned-button-wrap .footer-buttons .publication-footer .recommendations .email-input-wrap .sideBySideWrap .digest-cta .embedded-post nav footer aside form button [role=dialog] [aria-label=responses]".split(),
        *("[data-testid=audioPlayButton]", "[data-testid=headerClapButton]", "[data-testid=headerSocialShareButton]", "[data-testid=headerBookmarkButton]", "[data-testid=storyFooter]", "[data-testid=authorFooter]", "[data-testid=post-sidebar]"),
    ),
    ("h1[data-testid=storyTitle]", ".post-title", "h1.post-title", "article h1", "h1"),
    climb=("article section .pw-post-body-paragraph", "section"),
)
PDF = Adapter(
    "pdf",
    (),
    note="The text of a PDF can't be reached from its page.",
    signs=("embed[type='application/pdf']", "embed[type='application/x-google-chrome-pdf']", "object[type='application/pdf']", "#plugin", "pdf-viewer"),
)
REGISTRY = (PDF, WIKI, DOCS, NOTION, GITHUB, STACK, ARXIV, BLOG)
CTA = (
    r"(?i)^(sign up|sign in|log ?in|subscribe|subscribed|subscribe now|share|share this( post)?|listen|listen now|save|follow|following|upgrade to paid|leave a comment|comment|comments|"
    r"give a gift subscription|pledge your support|get started|read more|more from medium|recommended from medium|written by|edit|reply|like|likes|claps?|[0-9,.k]+ ?(claps?|likes?)|"
    r"copy link|email|notes|restack|previous|next|home|archive|about)[.!:]?$"
)
FOOTER = r"(?i)^(more from|recommended from medium|related|share this post|discussion about this|comments?|subscribe to|previously|read more)"
MARKDOWN = r"(?i)\.(md|markdown|mdx|mdown|rst|txt|adoc|asciidoc)$"
BLOB = "/(blob|blame)/"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)


def adapter_of(url: Column, registry=REGISTRY) -> Column:
    """Name of the first adapter for the address, or null."""
    tests = [(a.name, url_path(url).rlike(r"(?i)\.pdf$") if a is PDF else host_matches(url, *a.domains) & url_path(url).contains(a.path)) for a in registry]
    return F.coalesce(*[F.when(t, name) for name, t in tests]) if tests else F.lit(None).cast("string")


def signed(nodes: DataFrame, registry=REGISTRY) -> DataFrame:
    """(page_id, signed): pages that an element shows to be an adapter's, whatever their address; the first such adapter."""
    found = [(k, a.name, s) for k, a in enumerate(registry) for s in split_list(a.signs)]
    if not found:
        return nodes.select("page_id", F.lit(None).cast("string").alias("signed")).limit(0)
    which = F.array_min(F.array(*[F.when(css(s), F.struct(F.lit(k), F.lit(name).alias("name"))) for k, name, s in found]))
    return nodes.withColumn("__sign", which).groupBy("page_id").agg(F.min("__sign")["name"].alias("signed")).filter("signed IS NOT NULL")


def with_furniture(nodes: DataFrame, registry=REGISTRY) -> DataFrame:
    """`nodes` (adapter, ...) with skip: whether a node is furniture of its site."""
    return marked(nodes, {a.name: a.skip for a in registry if a.skip}, "skip")


def _first(nodes: DataFrame, choices: dict[str, tuple[str, ...]]) -> DataFrame:
    """Of each page the first element of the first selector of its adapter that matches any."""
    return ranked(nodes, choices).groupBy("page_id").agg(F.min_by(F.struct("adapter", "rank", "seq", "end", "t_from", "t_to"), F.struct("rank", "seq")).alias("x")).select("page_id", "x.*")


def _climbed(found: DataFrame, nodes: DataFrame, registry) -> DataFrame:
    """`found` (one element a page), but for adapters that climb the nearest ancestor of a tag."""
    for a in registry:
        if not a.climb:
            continue
        start = found.filter((F.col("adapter") == a.name) & (F.col("rank") == list(a.containers).index(a.climb[0])))
        up = nodes.filter((F.col("adapter") == a.name) & (F.col("tag") == a.climb[1])).select("page_id", F.struct("seq", "end").alias("up"))
        over = start.join(up, "page_id").filter((F.col("up.seq") < F.col("seq")) & (F.col("up.end") > F.col("seq"))).groupBy("page_id").agg(F.max("up").alias("up"))
        found = found.join(over, "page_id", "left").withColumns({"seq": F.coalesce("up.seq", "seq"), "end": F.coalesce("up.end", "end")}).drop("up")
    return found


def inside_of(rows: DataFrame, spans: DataFrame, *names: str) -> DataFrame:
    """`rows` (page_id, seq, ...) inside one of `spans` (page_id, a, z, names), which don't overlap, with its a and names: the
    last span that began before a row, if it isn't over."""
    none = [F.lit(None).cast(spans.schema[n].dataType).alias(n) for n in ("z", *names)]
    rest = [c for c in rows.columns if c not in ("page_id", "seq")]
    begun = spans.select("page_id", F.col("a").alias("seq"), *["z", *names], F.lit(True).alias("__span"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest])
    both = rows.select("page_id", "seq", *none, F.lit(False).alias("__span"), *rest).unionByName(begun)
    order = Window.partitionBy("page_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__span"), F.struct(F.col("seq").alias("a"), "z", *names)), ignorenulls=True).over(order)
    held = both.withColumn("__in", last).filter((~F.col("__span")) & (F.col("__in.z") > F.col("seq")))
    return held.select("page_id", "seq", *rest, "__in.a", *[F.col("__in")[n].alias(n) for n in names])


def containers(nodes: DataFrame, registry=REGISTRY) -> DataFrame:
    """(page_id, source, c_seq, c_end, label) of adapters' nodes; sources are in the order of reading."""
    main = _climbed(_first(nodes, {a.name: a.containers for a in registry if a.containers}), nodes, registry)
    body = main.select("page_id", F.lit("adapter#1000").alias("source"), F.col("seq").alias("c_seq"), F.col("end").alias("c_end"), F.when(F.col("adapter") == STACK.name, "Question").alias("label"))
    # Answers that are in no other answer, the accepted ones first.
    answer = ~F.col("is_text") & (has_class("answer") | attr("id").startswith("answer-"))
    stack = nodes.filter(F.col("adapter") == STACK.name)
    before = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    nested = F.coalesce(F.max("end").over(before), F.lit(0)) > F.col("seq")
    outer = stack.filter(F.coalesce(answer, F.lit(False))).withColumn("nested", nested).filter("NOT nested")
    outer = outer.select("page_id", F.col("seq").alias("a"), F.col("end").alias("z"), F.coalesce(has_class("accepted-answer"), F.lit(False)).alias("chosen"))
    sign = css(".js-accepted-answer-indicator:not(.d-none)") | css(".vote-accepted-on")
    part = F.when(css(".s-prose"), 0).when(css(".post-text"), 1).when(sign, 2)
    parts = inside_of(stack.withColumn("part", part).filter("part IS NOT NULL").select("page_id", "seq", "end", "part"), outer, "chosen")
    text = F.min(F.when(F.col("part") < 2, F.struct("part", "seq", "end")))
    answers = parts.groupBy("page_id", "a", "chosen").agg(text.alias("p"), F.max(F.col("part") == 2).alias("signed")).filter("p IS NOT NULL")
    answers = answers.withColumn("accepted", F.col("chosen") | F.col("signed"))
    k = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("accepted"), "a"))
    replies = answers.withColumn("k", k).select("page_id", F.format_string("adapter#2%03d", "k").alias("source"), F.col("p.seq").alias("c_seq"), F.col("p.end").alias("c_end"), F.when(F.col("accepted"), "Accepted answer").otherwise(F.concat(F.lit("Answer "), F.col("k").cast("string"))).alias("label"))
    return body.unionByName(replies)


def whole_text(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """`picks` (page_id, t_from, t_to, ...) that have text, with text: all text of their subtrees, collapsed; raw: as it is.
    A page's pieces of text stand in one array, of which each pick's are a slice: the work is the length of the results."""
    pieces = F.sort_array(F.collect_list(F.struct("t_from", "text")))["text"].alias("pieces")
    texts = nodes.filter(F.col("tag") == TEXT).groupBy("page_id").agg(pieces)
    own = [c for c in picks.columns if c != "page_id"]
    grouped = picks.filter("t_to > t_from").groupBy("page_id").agg(F.collect_list(F.struct(*own)).alias("picks"))
    raw = lambda p: F.array_join(F.slice("pieces", p["t_from"] + 1, p["t_to"] - p["t_from"]), "")
    each = grouped.join(texts, "page_id").select("page_id", F.inline(F.transform("picks", lambda p: F.struct(*[p[c].alias(c) for c in own], raw(p).alias("raw")))))
    return each.withColumn("text", collapse(F.col("raw")))


def restated(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(page_id, text): the texts of `needles` that a text of `hay` on their page contains. A text of three characters or more
    is looked for only where its rarest run of three is; shorter ones must be in none."""
    grams = lambda text: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda k: F.substring(text, k, 3)))
    each = needles.filter("char_length(text) > 2").select("page_id", "text").distinct().select("page_id", "text", F.explode(grams(F.col("text"))).alias("gram"))
    places = hay.filter("char_length(text) > 2").select("page_id", F.col("text").alias("told"), F.monotonically_increasing_id().alias("k"))
    told = places.select("page_id", "k", F.explode(grams(F.col("told"))).alias("gram")).join(each.select("page_id", "gram").distinct(), ["page_id", "gram"], "left_semi")
    often = told.groupBy("page_id", "gram").agg(F.collect_list("k").alias("ks"))
    # A text of which a run is nowhere is nowhere.
    rarest = each.join(often, ["page_id", "gram"], "left").groupBy("page_id", "text").agg(F.min_by("ks", F.coalesce(F.size("ks"), F.lit(0))).alias("ks"), F.max(F.col("ks").isNull()).alias("absent"))
    at = rarest.filter("NOT absent").select("page_id", "text", F.explode("ks").alias("k"))
    return at.join(places, ["page_id", "k"]).filter(F.contains("told", "text")).select("page_id", "text").distinct()


def pieces(nodes: DataFrame, registry=REGISTRY) -> DataFrame:
    """Blocks that are whole elements: titles first, then pieces in page order. (page_id, source, at, kind, level, text)."""
    titles = _first(nodes, {a.name: a.titles for a in registry if a.titles}).select("page_id", F.lit("adapter#0000").alias("source"), "seq", "t_from", "t_to", F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.lit("").alias("cut"), F.lit("").alias("before"))
    one = lambda kind, level, cut, before: F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), F.lit(cut).alias("cut"), F.lit(before).alias("before"))
    spec = F.coalesce(*[F.when((F.col("adapter") == a.name) & css(selector), one(*how)) for a in registry for selector, *how in a.pieces])
    parts = nodes.withColumn("spec", spec).filter("spec IS NOT NULL").select("page_id", F.lit("adapter#3000").alias("source"), "seq", "t_from", "t_to", "spec.*")
    found = stored(whole_text(nodes, stored(titles.unionByName(parts), "picks")), "pieces")
    cut = F.expr("CASE WHEN cut = '' THEN text ELSE regexp_replace(text, cut, '') END")
    text = F.when(F.col("kind") == "code", F.regexp_replace(F.regexp_replace("raw", r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")).otherwise(cut)
    return found.withColumn("said", text).filter("said <> ''").select("page_id", "source", F.col("seq").alias("at"), "kind", "level", F.concat("before", "said").alias("text"))


def _stop_ids(nodes: DataFrame) -> DataFrame:
    """(page_id, at): headings of wiki pages whose id, or that of the headline in them, is an appendix's."""
    wiki = nodes.filter(F.col("adapter") == WIKI.name)
    named = F.lower(attr("id")).isin(*WIKI_STOP)
    heads = wiki.filter(F.col("tag").rlike("^h[1-6]$") | (attr("role") == "heading"))
    lines = wiki.filter(css(".mw-headline") & named).select("page_id", "seq")
    held = inside_of(lines, heads.select("page_id", F.col("seq").alias("a"), F.col("end").alias("z")))
    return heads.filter(named).select("page_id", F.col("seq").alias("at")).unionByName(held.select("page_id", F.col("a").alias("at"))).distinct()


def finished(blocks: DataFrame, pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adapters' blocks (page_id, source, at, kind, ...) with what is put around and cut off, by site."""
    rows = blocks.join(pages.select("page_id", "adapter", "url"), "page_id")
    site = lambda a: F.col("adapter") == a.name
    path = url_path(F.col("url"))
    rows = rows.join(_stop_ids(nodes).withColumn("stop_id", F.lit(True)), ["page_id", "at"], "left")
    rows = rows.withColumn("text", F.when(site(WIKI), F.btrim(F.regexp_replace("text", r"(?i)\[\s*edit\s*\]", ""))).otherwise(F.col("text")))
    name = F.replace(F.btrim(F.regexp_replace(F.lower("text"), "[^a-z ]", "")), F.lit(" "), F.lit("_"))
    stop = (F.col("kind") == "heading") & ((site(WIKI) & (name.isin(*WIKI_STOP) | F.coalesce("stop_id", F.lit(False)))) | (site(BLOG) & (F.col("source") > "adapter#0000") & F.col("text").rlike(FOOTER)))
    upto = Window.partitionBy("page_id", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy("page_id")
    title = F.max(F.when(F.col("source") == "adapter#0000", F.col("text"))).over(page)
    prose = F.max((F.col("source") == "adapter#1000").cast("int")).over(page) == 1
    # Captions that no block has are put at the end, but for those past the cut.
    caption = site(WIKI) & (F.col("source") == "adapter#3000")
    cut_at = F.coalesce(F.min(F.when(stop, F.col("at"))).over(page), F.lit(2**31 - 1))
    rows = stored(rows.withColumns({"cut_at": cut_at, "is_caption": caption, "stop": F.coalesce(stop, F.lit(False)), "title": title, "prose": prose}), "unfinished")
    told = restated(rows.filter("is_caption"), rows.filter("adapter = 'wikipedia' AND source = 'adapter#1000' AND at < cut_at"))
    rows = rows.join(told.withColumn("told", F.lit(True)), ["page_id", "text"], "left")
    title, prose, stop, caption = (F.col(c) for c in ("title", "prose", "stop", "is_caption"))
    blob = path.rlike(BLOB) & ~path.rlike(MARKDOWN)
    drop = (
        (site(BLOG) & (F.char_length("text") <= 40) & F.col("text").rlike(CTA))
        | (site(BLOG) & (F.col("source") > "adapter#0000") & (F.col("text") == title))
        | (site(DOCS) & (F.col("source") == "adapter#3000") & prose)
        | (site(GITHUB) & ((F.col("source") == "adapter#3000") != blob))
        | (site(NOTION) & (F.col("source") > "adapter#0000") & (F.col("text") == title))
        | (site(STACK) & ~prose)
        | (caption & (F.coalesce("told", F.lit(False)) | (F.col("at") >= F.col("cut_at")) | (F.char_length("text") < 3)))
        | ((F.col("kind") != "code") & (F.char_length("text") < 2))
    )
    # Stored, as four parts of the result read it.
    kept = rows.withColumns({"stopped": F.max(stop.cast("int")).over(upto) == 1, "gone": F.coalesce(drop, F.lit(False))}).filter("NOT stopped AND NOT gone")
    kept = stored(kept, "adapted")
    files = kept.filter(site(GITHUB) & path.rlike(BLOB)).select("page_id", F.element_at(F.split(path, "/"), -1).alias("text")).distinct()
    none = F.lit(None)
    extra = lambda df, source, at, level: df.select("page_id", source.alias("source"), at.alias("at"), F.lit("heading").alias("kind"), F.lit(level).alias("level"), "text", none.cast("string").alias("uid"), none.cast(blocks.schema["meta"].dataType).alias("meta"))
    abstract = kept.filter(site(ARXIV) & (F.col("kind") == "paragraph") & ~F.col("text").startswith("Authors: ")).select("page_id", "source", "at", F.lit("Abstract").alias("text"))
    labels = kept.filter("label IS NOT NULL").groupBy("page_id", "source").agg(F.min("at").alias("at"), F.first("label").alias("text"))
    parts = [kept.select(*blocks.drop("label").columns), extra(files, F.lit("adapter#0000"), F.lit(-1), 1), extra(abstract, F.col("source"), F.col("at") - 1, 2), extra(labels, F.col("source"), F.col("at") - 1, 2)]
    return reduce(DataFrame.unionByName, parts)
