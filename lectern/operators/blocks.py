"""Blocks in reading order from node rows inside a container.

Subtrees that are pruned (hidden, page furniture, a block already taken) are intervals of node numbers, so a node is
covered if the running maximum of their ends is past it. Texts belong to the block whose interval they lie in. All
windows run by page and container in node order, so nodes are shuffled and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_code, collapse, whitespace_words
from lectern.operators.nodes import NEAR, attr
from lectern.plans.storage import stored
from lectern.schema import BLOCK, META

#: Tag sets.
SKIP_TAGS = tuple("script style noscript template svg iframe canvas video audio object embed map area button select textarea input option datalist link meta head".split())
STAMP_TAGS = tuple("p li h1 h2 h3 h4 h5 h6 blockquote pre code figure figcaption table dl dd dt ul ol math img div section article main aside nav header footer details summary address".split())
TERMINAL_TAGS = tuple("p li h1 h2 h3 h4 h5 h6 blockquote pre code figure figcaption table dd dt math".split())
LOOSE_TAGS = tuple("div section article main aside header footer nav td th details summary address center".split())
CHROME_TAGS = ("nav", "header", "footer", "aside")
CHROME_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search")
MATH_CLASSES = ("katex", "katex-display", "MathJax", "MathJax_Display", "mjx-container", "math-inline", "math-display")
#: Least characters of loose text and of a picture's text; most elements of a page that can be highlighted.
MIN_LOOSE, MIN_ALT, MAX_STAMPS = 12, 3, 20_000
#: How many elements up from a block one is looked for that can be highlighted.
UID_LEVELS = NEAR

BY = ("page_id", "source")


def mathy() -> Column:
    # Most elements have no class.
    return (attr("class") != "") & F.arrays_overlap(F.split(attr("class"), r"\s+"), F.array(*map(F.lit, MATH_CLASSES)))


def hidden() -> Column:
    """By attributes and inline style; what style sheets hide has the attribute by then."""
    style = attr("style").rlike(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
    return F.coalesce((attr("aria-hidden") == "true") | F.map_contains_key("attrs", "hidden") | style, F.lit(False))


def kind_of() -> Column:
    """Kind of block that an element is by its tag, or null."""
    tag = F.col("tag")
    return (
        F.when((tag == "math") | mathy(), "math")
        .when(tag.isin("h1", "h2", "h3", "h4", "h5", "h6") | (attr("role") == "heading"), "heading")
        .when(tag.isin("pre", "code"), "code")
        .when(tag == "table", "table")
        .when(tag.isin("figure", "figcaption", "img"), "figure")
        .when(tag == "blockquote", "quote")
        .when(tag.isin("li", "dd", "dt"), "list-item")
        .when(tag == "p", "paragraph")
    )


def level_of() -> Column:
    aria = F.expr("try_cast(regexp_extract(coalesce(try_element_at(attrs, 'aria-level'), ''), '^\\\\s*([0-9]+)', 1) AS INT)")
    tagged = F.expr("try_cast(regexp_extract(tag, '^h([1-6])$', 1) AS INT)")
    return F.when(F.col("kind") == "heading", F.coalesce(tagged, F.when(aria.between(1, 6), aria), F.lit(2)))


def _order(by: tuple[str, ...] = BY):
    return Window.partitionBy(*by).orderBy("seq")


def inside(test: Column, strictly_before: bool = True, by: tuple[str, ...] = BY) -> Column:
    """Whether a node lies in the subtree of an earlier node with the property."""
    frame = _order(by).rowsBetween(Window.unboundedPreceding, -1 if strictly_before else 0)
    return F.coalesce(F.max(F.when(test, F.col("end"))).over(frame), F.lit(0)) > F.col("seq")


def subtree_sums(rows: DataFrame, by: tuple[str, ...] = BY, where: Column | None = None, **sums: Column) -> DataFrame:
    """`rows` (by, seq, end, ...) with sums over the nodes below each element, without itself; below those that `where` asks
    for, if it is given, and 0 elsewhere.

    An element stands twice in a page's order, where it begins and where it ends; the sum of what is below it is the running
    sum at its end less that at its beginning. All runs by page, so rows that are there by page are shuffled no more.
    """
    values = {f"__{k}": F.coalesce(v.cast("long"), F.lit(0)) for k, v in sums.items()}
    ends = F.array(F.lit(True), F.lit(False))
    holds = F.col("end") > F.col("seq") + 1
    holds = holds if where is None else holds & F.coalesce(where, F.lit(False))
    twice = rows.withColumns(values).withColumn("__opens", F.explode(F.when(holds, ends).otherwise(F.array(F.lit(True)))))
    opens, keys = F.col("__opens"), {*by, "seq", "end"}
    # Where it ends it carries nothing but its numbers.
    light = twice.select(*keys, "__opens", *[F.when(opens, F.col(c)).alias(c) for c in rows.columns if c not in keys], *[F.when(opens, F.col(v)).otherwise(0).alias(v) for v in values])
    place = F.when(opens, F.col("seq")).otherwise(F.col("end"))
    so_far = Window.partitionBy(*by).orderBy("__place", "__opens").rowsBetween(Window.unboundedPreceding, 0)
    run = light.withColumn("__place", place).withColumns({v: F.sum(v).over(so_far) for v in values})
    pair = Window.partitionBy(*by, "seq").orderBy(F.desc("__opens"))
    below = {k: F.coalesce(F.lead(f"__{k}").over(pair) - F.col(f"__{k}"), F.lit(0)) for k in sums}
    return run.withColumns(below).filter("__opens").select(*rows.columns, *sums)


def with_stamps(rows: DataFrame) -> DataFrame:
    """`rows` with stamp: the number of an element that can be highlighted, at most MAX_STAMPS a page."""
    dead = F.col("tag").isin(*SKIP_TAGS) | hidden()
    can = ~F.col("is_text") & ~dead & ~inside(dead, by=("page_id",)) & (F.col("tag").isin(*STAMP_TAGS) | mathy())
    can = can & ((F.col("tag") != "img") | (F.char_length(F.trim(attr("alt"))) >= MIN_ALT))
    out = rows.withColumn("__can", F.coalesce(can, F.lit(False)))
    number = F.sum(F.col("__can").cast("int")).over(_order(("page_id",)))
    return out.withColumn("stamp", F.when(F.col("__can") & (number <= MAX_STAMPS), number)).drop("__can")


def held_by(nodes: DataFrame, containers: DataFrame) -> DataFrame:
    """Node rows that containers (page_id, source, c_seq, c_end) hold, with these columns. A source's name up to '#' is its
    family; containers of a family don't overlap, so a node's is the last that began, if it isn't over. Pages are read once
    for each of their families, however many containers these have."""
    spans = containers.withColumn("family", F.split("source", "#")[0])
    each = nodes.join(spans.select("page_id", "family").distinct(), "page_id")
    starts = spans.select("page_id", "family", F.col("c_seq").alias("seq"), F.struct("source", "c_seq", "c_end").alias("span"))
    # Dealt by page, which all later windows and groups by page and container can use as it is.
    marked = each.join(starts, ["page_id", "family", "seq"], "left").repartition("page_id")
    order = Window.partitionBy("page_id", "family").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.withColumn("span", F.last("span", ignorenulls=True).over(order)).filter(F.col("span.c_end") > F.col("seq"))
    return last.select(*nodes.columns, "span.source", "span.c_seq", "span.c_end")


def blocks_from(nodes: DataFrame, containers: DataFrame) -> DataFrame:
    """Exploded blocks (page_id, source, at, kind, level, text, uid, meta) of node rows (page_id, seq, end, near, ...,
    stamp) inside containers (page_id, source, c_seq, c_end); rows may have skip: adapters' furniture."""
    rows = held_by(nodes, containers)
    skip = F.coalesce(F.col("skip"), F.lit(False)) & F.col("source").startswith("adapter") if "skip" in nodes.columns else F.lit(False)
    is_root = F.col("seq") == F.col("c_seq")
    element = ~F.col("is_text")
    unread = element & (F.col("tag").isin(*SKIP_TAGS) | hidden() | skip)
    chrome = element & (F.col("tag").isin(*CHROME_TAGS) | ((attr("role") != "") & F.lower(attr("role")).isin(*CHROME_ROLES)))
    rows = rows.withColumns({"kind": F.when(element, kind_of()), "unread": unread, "furniture": chrome & ~is_root})
    rows = rows.withColumn("dead", F.col("unread") | inside(F.col("unread")))

    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    alive_text = F.col("is_text") & ~F.col("dead")
    terminal = element & (F.col("tag").isin(*TERMINAL_TAGS) | ((F.col("tag") == "img") & F.map_contains_key("attrs", "alt")))
    chars = F.when(F.col("is_text"), F.char_length(F.btrim(blank))).otherwise(0)
    alive = ~F.col("dead")
    # Sums are asked for by elements that may be loose text, or tables, only.
    loose = element & F.col("tag").isin(*LOOSE_TAGS)
    rows = subtree_sums(rows, where=loose | (F.col("kind") == "table"), terminals=terminal, chars=chars, row_tags=(F.col("tag") == "tr") & alive, cell_tags=F.col("tag").isin("td", "th"))
    rows = subtree_sums(rows, where=loose, bearers=loose & ~hidden() & (F.col("chars") >= MIN_LOOSE))

    takes_loose = loose & (F.col("terminals") == 0) & (F.col("bearers") == 0) & (F.col("chars") >= MIN_LOOSE - 1)
    layout = (F.col("kind") == "table") & (F.col("row_tags") <= 1) & (F.col("cell_tags") <= 1)
    bare_image = (F.col("tag") == "img") & (F.char_length(collapse(attr("alt"))) < MIN_ALT)
    takes = element & ~F.col("dead") & ((F.col("kind").isNotNull() & ~layout & ~bare_image) | (F.col("kind").isNull() & takes_loose))
    rows = rows.withColumn("takes", F.coalesce(takes, F.lit(False)))
    stops = F.col("unread") | F.col("furniture") | F.col("takes")
    rows = rows.withColumn("covered", inside(stops) | F.col("furniture"))
    head = F.col("takes") & ~F.col("covered")
    order = _order()
    rows = rows.withColumn("head", head)
    last_head = F.last(F.when(F.col("head"), F.struct("seq", "end", "tag")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", last_head).withColumn("at", F.when(F.col("own.end") > F.col("seq"), F.col("own.seq")))
    rows = rows.filter("at IS NOT NULL").withColumn("live", alive_text)
    rows = rows.withColumns({"in_caption": inside(F.col("tag") == "figcaption"), "in_annotation": inside(F.coalesce(F.col("tag").isin("annotation", "annotation-xml"), F.lit(False)))})
    inner = lambda c: F.when(F.col(c) >= F.col("at"), F.col(c))
    rows = rows.withColumns({"row": inner("in_row"), "cell": inner("in_cell")})

    piece = F.struct("seq", "text")
    joined = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(test, piece)))["text"], "")
    alt = collapse(attr("alt"))
    spoken_alt = F.coalesce(F.nullif(attr("alttext"), F.lit("")), F.nullif(attr("aria-label"), F.lit("")), F.nullif(attr("title"), F.lit("")))
    # Of the rows of a block one is its head.
    opening = F.struct("kind", level_of().alias("level"), "near", spoken_alt.alias("spoken"))
    grouped = rows.groupBy(*BY, "at").agg(
        F.first(F.when(F.col("head"), opening), ignorenulls=True).alias("opening"),
        joined(F.col("live")).alias("raw"),
        joined(F.col("live") & F.col("in_caption")).alias("caption"),
        joined(F.col("is_text") & F.col("in_annotation")).alias("annotation"),
        F.min_by(F.when(F.col("tag") == "img", alt), F.when((F.col("tag") == "img") & (F.char_length(alt) >= MIN_ALT), F.col("seq"))).alias("alt"),
        F.collect_list(F.when(F.col("live") & F.col("cell").isNotNull() & F.col("row").isNotNull(), F.struct("row", "cell", "seq", "text"))).alias("cells"),
        F.collect_set(F.when(F.coalesce(F.col("tag").isin("td", "th"), F.lit(False)), F.struct("row", "cell"))).alias("grid"),
    )
    # Stored, as windows and sums of all nodes stand behind it and four later steps read it.
    grouped = stored(grouped.select(*BY, "at", "opening.*", *[c for c in grouped.columns if c not in (*BY, "at", "opening")]), "grouped")
    table = _tables(grouped)
    plain, nonblank = collapse(F.col("raw")), lambda c: F.nullif(collapse(F.coalesce(c, F.lit(""))), F.lit(""))
    code = clean_code(F.col("raw"))
    text = (
        F.when(F.col("kind") == "code", code)
        .when(F.col("kind") == "math", F.coalesce(nonblank(F.col("annotation")), nonblank(F.col("spoken")), plain))
        .when(F.col("kind") == "figure", F.coalesce(nonblank(F.col("caption")), F.col("alt"), plain))
        .when(F.col("kind") == "table", F.coalesce("lines", F.lit("")))
        .otherwise(plain)
    )
    none = F.lit(None)
    meta = F.struct(
        F.when(F.col("kind") == "code", F.size(F.split(code, "\n"))).cast("int").alias("lines"),
        F.when(F.col("kind") == "table", F.coalesce("n_rows", F.lit(0))).cast("int").alias("rows"),
        F.when(F.col("kind") == "table", F.coalesce("n_cols", F.lit(0))).cast("int").alias("cols"),
        none.cast("string").alias("file"),
        F.when(F.col("kind") == "table", F.col("table_cells")).alias("cells"),
    )
    out = grouped.join(table, [*BY, "at"], "left").withColumn("loose", F.col("kind").isNull()).withColumns({"text": text, "meta": F.when(F.col("kind").isin("code", "table"), meta).cast(META), "kind": F.coalesce("kind", F.lit("paragraph"))})
    out = stored(out.select(*BY, "at", "kind", "level", "near", "text", "meta", "loose"), "texts")
    out = out.filter((F.trim("text") != "") & (~F.col("loose") | ((F.char_length("text") >= MIN_LOOSE) & (whitespace_words(F.col("text")) >= 2))))
    return _with_uids(out, nodes).select(*BY, "at", "kind", "level", "text", "uid", "meta")


def _tables(grouped: DataFrame) -> DataFrame:
    """Lines, cells, rows and columns of table blocks."""
    tables = grouped.filter("kind = 'table'")
    pieces = tables.select(*BY, "at", F.explode("cells").alias("c"))
    cells = pieces.groupBy(*BY, "at", "c.row", "c.cell").agg(collapse(F.array_join(F.sort_array(F.collect_list(F.struct("c.seq", "c.text")))["text"], "")).alias("text"))
    rows = cells.groupBy(*BY, "at", "row").agg(F.sort_array(F.collect_list(F.struct("cell", "text"))).alias("texts"))
    full = lambda texts: F.filter(F.transform(texts, lambda t: t["text"]), lambda t: t != "")
    rows = rows.withColumns({"line": F.array_join(full(F.col("texts")), ", "), "said": F.transform("texts", lambda t: t["text"])})
    lines = rows.filter("line <> ''").groupBy(*BY, "at").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("row", "line")))["line"], ". ").alias("lines"),
        F.sort_array(F.collect_list(F.struct("row", "said")))["said"].alias("table_cells"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    grid = tables.select(*BY, "at", F.explode("grid").alias("g")).groupBy(*BY, "at", "g.row").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(grid.groupBy(*BY, "at").agg(F.max("n").alias("n_cols")), [*BY, "at"], "left")


def _with_uids(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nearest stamp within UID_LEVELS, for the first block of the page that claims it."""
    stamps = nodes.filter("stamp IS NOT NULL").select("page_id", F.col("seq").alias("anchor"), "stamp")
    found = blocks.select(*BY, "at", F.explode("near").alias("anchor")).join(stamps, ["page_id", "anchor"])
    best = found.groupBy(*BY, "at").agg(F.max_by("stamp", "anchor").alias("stamp"))
    first = Window.partitionBy(*BY, "stamp").orderBy("at")
    claimed = best.withColumn("uid", F.when(F.row_number().over(first) == 1, F.concat(F.lit("u"), F.col("stamp").cast("string")))).drop("stamp")
    return blocks.join(claimed, [*BY, "at"], "left")


def _unstated():
    """Of each of an array of texts whether it stays, in one pass with the text kept last as all its state; a hundred pages at a time."""

    def keep(texts: list[str]) -> list[bool]:
        kept: list[int] = []
        for k, text in enumerate(texts):
            if kept and text in texts[kept[-1]]:
                continue
            if kept and texts[kept[-1]] in text:
                kept[-1] = k
            else:
                kept.append(k)
        stay = {*kept}
        return [k in stay for k in range(len(texts))]

    return F.udf(keep, "array<boolean>", useArrow=False)


def without_restated(blocks: Column) -> Column:
    """Ordered blocks, without those that the block kept before contains; a block that contains that one replaces it."""
    told = F.arrays_zip(blocks.alias("block"), _unstated()(blocks["text"]).alias("stays"))
    return F.transform(F.filter(told, lambda x: x["stays"]), lambda x: x["block"])


def numbered(blocks: Column) -> Column:
    """Blocks with seq and id by their place."""
    return F.transform(blocks, lambda b, i: F.struct(i.cast("int").alias("seq"), F.concat(F.lit("b"), i.cast("string")).alias("id"), b["kind"].alias("kind"), b["level"].alias("level"), b["text"].alias("text"), b["uid"].alias("uid"), b["meta"].alias("meta")))


def gathered(blocks: DataFrame) -> DataFrame:
    """(page_id, source, blocks array) of exploded blocks in the order of `at`."""
    none = F.lit(None)
    row = F.struct(F.col("at").alias("seq"), none.cast("string").alias("id"), "kind", "level", "text", "uid", "meta")
    whole = blocks.groupBy(*BY).agg(F.sort_array(F.collect_list(row)).alias("blocks"))
    return whole.select(*BY, numbered(without_restated(F.col("blocks").cast(f"array<{BLOCK.simpleString()}>"))).alias("blocks"))


__all__ = ["blocks_from", "gathered", "hidden", "inside", "kind_of", "numbered", "subtree_sums", "with_stamps", "without_restated"]
