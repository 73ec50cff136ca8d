"""Registered queries over the tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import sentences as S
from lectern.functions import text as X
from lectern.operators import accounting as A
from lectern.operators.blocks import with_stamps
from lectern.operators.custom import register, with_urls
from lectern.operators.density import article_score, features
from lectern.operators.extract import extract
from lectern.operators.highlight import sentence_places
from lectern.operators.nodes import nodes
from lectern.operators.selectors import ranked
from lectern.operators.speech import speechify, stats
from lectern.plans.storage import shared_path, spread, stored
from lectern.sources.cache_store import CacheStore
from lectern.sources.tables import from_documents, from_pdf, from_selection, readable, table
from lectern.streaming.player import debounced

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTERED[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- texts -------------------------------------------------------------------------------------------------------------

_WS = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def _chain(start: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, to in pairs:
        start = f"regexp_replace({start}, '{pattern}', '{to}', 'g')"
    return start


def _collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'))"


def _tidy_sql(x: str) -> str:
    x = f"regexp_replace({x}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g')"
    x = f"translate({x}, '‘’‛“”‟', '''''''\"\"\"')"
    return _collapse_sql(f"replace(regexp_replace({x}, '[\\x{{2013}}\\x{{2014}}\\x{{2212}}]', ' - ', 'g'), '…', '...')")


def _normal_sql(x: str) -> str:
    s = f"[{_WS}]"
    x = _chain(x, [(rf"(?i)\[{s}*(?:[0-9]+|[a-z]|citation needed|edit|sic|note [0-9]+|\.\.\.|…){s}*\]", ""), (rf"\[{s}{{0,80}}\]", " "), (rf"\[{s}*([^\]]{{0,80}}?){s}*\]", " \\1 "), (r"[\[\]]", "")])
    x = _chain(x, [(r"\b[A-Za-z0-9_][A-Za-z0-9_.+-]*@([A-Za-z0-9_-]+)\.[A-Za-z0-9_.]+", "email at \\1")])
    for begin in (r"https?://(?:www\.)?", r"www\."):
        x = f"regexp_replace({x}, '(?i)\\b{begin}([^{_WS}/]+)[^{_WS}]*', chr(2) || '\\1' || chr(3), 'g')"
    # Between the two marks stands a host, whose dots are said.
    x = f"array_to_string(list_transform(string_split({x}, chr(2)), lambda p: CASE WHEN contains(p, chr(3)) THEN replace(split_part(p, chr(3), 1), '.', ' dot ') || split_part(p, chr(3), 2) ELSE p END), '')"
    words = [(rf"(?i)\be\.{s}?g\.{s}*", "for example, "), (rf"(?i)\bi\.{s}?e\.{s}*", "that is, "), (rf"(?i)\betc\.({s}|$)", "et cetera\\1")]
    words += [(rf"(?i)\b{short}({s})", f"{long}\\1") for short, long in ((r"vs\.?", "versus"), (r"cf\.", "compare"), (r"viz\.", "namely"), (r"approx\.", "approximately"))]
    words += [(rf"\b{short}\.{s}*([0-9])", f"{long} \\1") for short, long in (("Fig", "Figure"), ("Eq", "Equation"), ("Vol", "Volume"), ("No", "Number"))]
    words += [(rf"\b{short}\.{s}+", f"{long} ") for short, long in (("Dr", "Doctor"), ("Prof", "Professor"), ("Mr", "Mister"), ("Mrs", "Missus"), ("Ms", "Miss"), ("St", "Saint"))]
    words += [(rf"(?i)\bet{s}+al\.", "and others")]
    words += [(rf"{sign}{s}?([0-9][0-9,]*(?:\.[0-9]+)?)", f"\\1 {name}") for sign, name in (("\\$", "dollars"), ("₹", "rupees"), ("€", "euros"), ("£", "pounds"))]
    units = {"km": "kilometers", "kg": "kilograms", "cm": "centimeters", "mm": "millimeters", "ft": "feet", "GHz": "gigahertz", "Hz": "hertz", "TB": "terabytes", "GB": "gigabytes", "MB": "megabytes", "KB": "kilobytes"}
    words += [(rf"([0-9]){s}?{unit}\b", f"\\1 {name}") for unit, name in units.items()]
    words += [(f"{s}&{s}", " and "), (f"([0-9]){s}?%", "\\1 percent"), ("#([0-9])", "number \\1"), (r"(?i)\band/or\b", "and or"), (rf"{s}\+{s}", " plus "), (f"{s}={s}", " equals "), (f"([^{_WS}])@([^{_WS}])", "\\1 at \\2")]
    return _tidy_sql(_chain(x, words))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


@query(f"SELECT doc_id, {_tidy_sql('text')} AS tidy FROM documents")
def text_tidy(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", X.tidy(F.col("text")).alias("tidy"))


@query(f"SELECT doc_id, {_normal_sql('text')} AS prose FROM documents")
def text_normalize(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", X.normalize_prose(F.col("text")).alias("prose"))


@query(
    f"""SELECT doc_id, strlen(text) AS bytes, CAST(len(list_filter(regexp_split_to_array(text, '[{_WS}]+'), lambda w: w <> '')) AS INTEGER) AS words,
    regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS speakable FROM documents"""
)
def text_measures(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select("doc_id", X.utf8_bytes(t).cast("long").alias("bytes"), X.word_count(t).alias("words"), X.is_speakable(t).alias("speakable"))


_MASKED = (
    f"regexp_replace({_tidy_sql('text')}, '\\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Mt|Rev|Hon|e\\.g|i\\.e|etc|cf|vs|viz|al|Fig|Eq|No|Vol|approx|est|dept|Inc|Ltd|Co)\\.', '\\1' || chr(1), 'g')"
)
_MASKED = f"regexp_replace(regexp_replace(regexp_replace(replace({_MASKED}, '...', chr(1) || chr(1) || chr(1)), '\\b([A-Z])\\.', '\\1' || chr(1), 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '^([{_WS}]*[0-9]+)\\.([{_WS}])', '\\1' || chr(1) || '\\2')"
_SPLIT = f"list_filter(list_transform(string_split(regexp_replace({_MASKED}, '([.!?。！？।])[{_WS}]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len({_SPLIT}) AS INTEGER) AS sentences, array_to_string({_SPLIT}, '|') AS joined FROM documents")
def sentences_regex(spark, sf_dir):
    found = _texts(spark, sf_dir).select("doc_id", S.regex_sentences(X.tidy(F.col("text"))).alias("s"))
    return found.select("doc_id", F.size("s").alias("sentences"), F.array_join("s", "|").alias("joined"))


@query()
def sentences_uax29(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", S.uax29_sentences(X.tidy(F.col("text"))).alias("s")).select("doc_id", F.size("s").alias("sentences"), F.array_join("s", "|").alias("joined"))


@query()
def chunks(spark, sf_dir):
    prose = _texts(spark, sf_dir).select("doc_id", X.normalize_prose(F.col("text")).alias("p"))
    made = prose.select("doc_id", S.chunked(F.col("p"), 420, 180).alias("c"))
    return made.select("doc_id", F.size("c").alias("chunks"), F.array_max(F.transform("c", F.char_length)).alias("longest"))


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, {_SPLIT} AS parts FROM documents),
    f(doc_id, i, chunk, size) AS (
        SELECT doc_id, 1, 0, length(parts[1]) FROM s WHERE len(parts) > 0 UNION ALL
        SELECT doc_id, i + 1, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN size + 1 + n ELSE n END
        FROM (SELECT *, size + 1 + n <= (CASE WHEN chunk = 0 THEN 180 ELSE 420 END) AS fits FROM (SELECT f.*, length(parts[i + 1]) AS n FROM f JOIN s USING (doc_id) WHERE i < len(parts)))
    ), c AS (SELECT doc_id, chunk, string_agg(parts[i], ' ' ORDER BY i) AS said FROM f JOIN s USING (doc_id) GROUP BY doc_id, chunk)
    SELECT s.doc_id, CAST(count(chunk) AS INTEGER) AS chunks, max(length(said)) AS longest, coalesce(string_agg(said, '|' ORDER BY chunk), '') AS joined FROM s LEFT JOIN c ON c.doc_id = s.doc_id GROUP BY s.doc_id"""
)
def chunks_regex(spark, sf_dir):
    """Chunks of the sentences that Spark's own expressions find."""
    made = _texts(spark, sf_dir).select("doc_id", S.merge_short(S.regex_sentences(X.tidy(F.col("text"))), 420, 180).alias("c"))
    return made.select("doc_id", F.size("c").alias("chunks"), F.array_max(F.transform("c", F.char_length)).cast("long").alias("longest"), F.array_join("c", "|").alias("joined"))


@query()
def document_utterances(spark, sf_dir):
    return speechify(from_documents(spread(table(spark, sf_dir, "documents"))))


@query()
def document_speech(spark, sf_dir):
    """What reading all documents aloud takes, by language."""
    docs = from_documents(spread(table(spark, sf_dir, "documents")))
    each = stats(docs, speechify(docs)).join(docs.select("page_id", "lang"), "page_id")
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("utterances", "total_bytes", "words", "est_seconds")])


@query(
    """SELECT doc_id, (CASE WHEN e >= 60 * 0.5 THEN 'about' ELSE 'under' END) AS length, chars || ' chars · ' || (CASE WHEN chars <= 400 THEN 'starts fast, choppier' WHEN chars >= 1400 THEN 'smoothest, slower start' ELSE 'balanced' END) AS label
    FROM (SELECT doc_id, n_chars AS chars, n_chars / 15.0 AS e FROM documents)"""
)
def labels_of_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(F.col("n_chars") / 15.0 >= 30, "about").otherwise("under").alias("length"), X.chunk_label(F.col("n_chars")).alias("label"))


# --- pages -------------------------------------------------------------------------------------------------------------


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(extract(readable(spread(table(spark, sf_dir, "pages")))), "extractions")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host, starts_with(url, 'about:') OR starts_with(url, 'chrome://') AS blocked FROM pages")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.blocked_url(F.col("url")).alias("blocked"))


_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', '{_char}')"


@query(f"SELECT page_id, {_collapse_sql(_TITLE)} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_titles(spark, sf_dir):
    return _extracted(spark, sf_dir).select("page_id", "title", "lang")


#: Pages of the tables are of one build: head, a list of links, an advertisement, an article of h1 and p, a footer.
_SAID = "regexp_replace({x}, '<[^>]*>', '', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _SAID = f"replace({_SAID}, '{_entity}', '{_char}')"


def _said_sql(x: str) -> str:
    return _SAID.replace("{x}", x)


#: Of each page that may be read the texts of h1 and all p, in order, and as blocks without those that restate others.
_ARTICLES = f"""parts AS (
    SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article, (length(html) - length(replace(html, '<li>', ''))) // 4 AS items,
    list_prepend(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')[2:]) AS raw
    FROM pages WHERE NOT (starts_with(url, 'about:') OR starts_with(url, 'chrome://'))
), texts AS (
    SELECT *, list_transform(range(len(raw)), lambda k: {{'i': k, 'text': {_collapse_sql(_said_sql("raw[k + 1]"))}, 'raw': {_said_sql("raw[k + 1]")}}}) AS said FROM parts
), sizes AS (
    SELECT *, length({_said_sql("article")}) AS size, length({_said_sql("body")}) AS around, regexp_extract(body, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, len(regexp_extract_all(body, '<[a-z]')) AS tags,
    len(list_filter(list_concat(list_transform(said, lambda s: s.raw), list_transform(regexp_extract_all(body, '(?s)<li>(.*?)</li>', 1), lambda s: {_said_sql("s")})), lambda s: length(s) >= 25)) AS prose,
    length(regexp_replace({_said_sql("body")}, '[^,，、؛]', '', 'g')) AS commas, length({_said_sql("array_to_string(regexp_extract_all(body, '(?s)<a [^>]*>(.*?)</a>', 1), '')")}) AS links
    FROM (SELECT *, regexp_extract(html, '(?s)<body>(.*)', 1) AS body FROM texts)
), found AS (
    SELECT *, CASE WHEN size >= 140 THEN said WHEN around >= 140 AND 12 * prose + 3 * least(commas, 60) + least(around / 100, 60) + least(around / (tags + 1), 40) - (CASE WHEN prose = 0 THEN 25 ELSE 0 END) - (CASE WHEN links > around / 2 THEN 40 ELSE 0 END) > 0
        THEN CASE WHEN length({_collapse_sql(_said_sql("ad"))}) >= 12 AND contains({_collapse_sql(_said_sql("ad"))}, ' ') THEN list_prepend({{'i': -2::BIGINT, 'text': {_collapse_sql(_said_sql("ad"))}, 'raw': {_said_sql("ad")}}}, said) ELSE said END
        ELSE said[:0] END AS told FROM sizes
), folded AS (
    SELECT *, CASE WHEN len(told) = 0 THEN [] ELSE list_reduce(list_transform(list_filter(told, lambda s: s.text <> ''), lambda s: [s]),
        lambda a, b: CASE WHEN contains(a[-1].text, b[1].text) THEN a WHEN contains(b[1].text, a[-1].text) THEN list_concat(a[:-2], b) ELSE list_concat(a, b) END) END AS kept FROM found
), scores AS (
    SELECT page_id, list_sum(list_transform(list_filter(list_append(list_transform(said[2:], lambda s: length(s.raw)), length({_said_sql("article")})), lambda n: n >= 140), lambda n: sqrt(n - 140))) AS score FROM texts
)"""


@query(f"WITH {_ARTICLES} SELECT page_id, round(coalesce(score, 0), 6) AS score, coalesce(score, 0) > 20 AS is_article FROM scores")
def article_scores(spark, sf_dir):
    """Whether a page looks like an article."""
    pages = readable(spread(table(spark, sf_dir, "pages")))
    return article_score(features(stored(nodes(pages), "nodes"))).select("page_id", F.round("score", 6).alias("score"), "is_article")


@query(
    f"""WITH {_ARTICLES} SELECT page_id, len(kept) > 0 AS ok, {_collapse_sql(_TITLE)} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    CASE WHEN len(kept) = 0 THEN 'none' WHEN score > 20 THEN 'readability' ELSE 'density' END AS strategy, CASE WHEN len(kept) = 0 THEN 'Nothing readable was found on this page.' END AS reason,
    CAST(coalesce(list_sum(list_transform(kept, lambda s: len(string_split(s.text, ' ')))), 0) AS INTEGER) AS word_count, CAST(len(kept) AS INTEGER) AS blocks FROM folded JOIN scores USING (page_id)"""
)
def page_extractions(spark, sf_dir):
    return _extracted(spark, sf_dir).select("page_id", "ok", "title", "lang", "strategy", "reason", "word_count", F.size("blocks").alias("blocks"))


@query(
    f"""WITH {_ARTICLES}, b AS (SELECT page_id, items, unnest(kept) AS s, unnest(range(len(kept))) AS k FROM folded)
    SELECT page_id, CAST(k AS INTEGER) AS seq, 'b' || k AS id, CASE WHEN s.i = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN s.i = 0 THEN 1 END AS level, s.text AS text, 'u' || (items + 5 + s.i) AS uid FROM b"""
)
def page_blocks(spark, sf_dir):
    return _extracted(spark, sf_dir).select("page_id", F.explode("blocks").alias("b")).select("page_id", "b.seq", "b.id", "b.kind", "b.level", "b.text", "b.uid")


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = readable(spread(table(spark, sf_dir, "pages")))
    return stored(with_stamps(nodes(pages)), "nodes")


_SELECTORS = ("nav li + li > a", "article > h1 + p", "article p ~ p", "body > div:not(.x).ad", "ul > li:first-child a", "nav + .ad, p > b")


@query(
    f"""WITH {_ARTICLES}, n AS (SELECT page_id, items, len(raw) - 1 AS paragraphs, (length(article) - length(replace(article, '<b>', ''))) // 3 AS bold FROM parts)
    SELECT page_id, k, CAST(CASE k WHEN 0 THEN items - 1 WHEN 1 THEN 1 WHEN 2 THEN paragraphs - 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE bold END AS BIGINT) AS found FROM n, range(7) r(k) WHERE k <> 2 OR paragraphs > 1"""
)
def page_selectors(spark, sf_dir):
    """How many elements of each page selectors with combinators find."""
    rows = _stamped(spark, sf_dir).withColumn("adapter", F.lit("page"))
    found = ranked(rows, {"page": _SELECTORS})
    return found.groupBy("page_id", F.col("rank").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("found"))


@query(
    f"""WITH {_ARTICLES}, b AS (SELECT page_id, unnest(kept) AS s FROM folded), c AS (SELECT page_id, s.i AS i, s.raw AS raw, trim(substr(s.text, 30, 90)) AS clean FROM b)
    SELECT page_id, CAST(i AS BIGINT) AS k, 0 AS piece, CAST(instr(raw, substr(clean, 1, 40)) - 1 AS INTEGER) AS start, CAST(least(instr(raw, substr(clean, 1, 40)) - 1 + length(clean), length(raw)) AS INTEGER) AS until
    FROM c WHERE length(clean) >= 4 AND instr(raw, substr(clean, 1, 40)) > 0"""
)
def page_highlights(spark, sf_dir):
    """Where a part of each block's text stands among the texts of its element."""
    rows = _stamped(spark, sf_dir)
    b = _extracted(spark, sf_dir).select("page_id", F.explode("blocks").alias("b"))
    items = rows.filter("tag = 'li' AND stamp IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("items"))
    said = b.join(items, "page_id").select("page_id", (F.substring("b.uid", 2, 9).cast("long") - F.col("items") - 5).alias("key"), "b.uid", F.concat(F.lit("[long-break] "), F.substring("b.text", 30, 90), F.lit(" [break]")).alias("text"))
    return sentence_places(said, rows).select("page_id", F.col("key").alias("k"), "piece", "start", F.col("end").alias("until"))


@query(
    f"""WITH {_ARTICLES}, c AS (
        SELECT page_id, items, {_collapse_sql("substr(said[1].raw, 4)")} AS head, {_collapse_sql("substr(said[2].raw, 1, 60)")} AS body FROM texts WHERE len(raw) > 1
    ), b AS (
        SELECT page_id, CASE WHEN head = '' OR contains(body, head) THEN [body] WHEN body = '' OR contains(head, body) THEN [head] ELSE [head, body] END AS said FROM c WHERE length(trim(head || ' ' || body)) > 20
    ) SELECT page_id, 'selection' AS strategy, array_to_string(said, '|') AS said FROM b"""
)
def page_selections(spark, sf_dir):
    """From the fourth letter of a page's heading to the sixtieth of its first paragraph."""
    pages = readable(spread(table(spark, sf_dir, "pages")))
    rows = stored(nodes(pages), "nodes")
    heads = rows.filter("tag = 'h1' AND t_to > t_from").groupBy("page_id").agg(F.min("t_from").alias("p"))
    first = rows.filter("tag = '#text'").join(heads, "page_id").filter("t_from = p + 1").select("page_id", "p")
    cut = F.struct(F.col("p").alias("from_piece"), F.lit(3).alias("from_at"), (F.col("p") + 1).alias("to_piece"), F.lit(60).alias("to_at"))
    out = extract(pages.join(first.select("page_id", cut.alias("range")), "page_id"), reader=False)
    return out.filter("strategy = 'selection'").select("page_id", "strategy", F.array_join("blocks.text", "|").alias("said"))


def _link_lists():
    """An adapter as users write them, which reads the lists of links of blogs."""

    class LinkLists:
        name = "link-lists"

        def match(self, url, page):
            return "://blog." in url

        def extract(self, page, url):
            nav = next(page.elements(tag="nav"), None)
            return nav and [{"kind": "list-item", "text": page.text_of(a), "node": a} for a in page.elements(tag="a", inside=nav)]

    return LinkLists()


@query(
    f"""SELECT page_id, 'link-lists' AS adapter, CAST(k - 1 AS INTEGER) AS place, {_said_sql("links[k]")} AS text FROM (SELECT page_id, unnest(range(1, len(links) + 1)) AS k, links FROM (
    SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1) AS links FROM pages WHERE contains(url, '://blog.'))) WHERE {_collapse_sql(_said_sql("links[k]"))} <> ''"""
)
def page_adapters(spark, sf_dir):
    """A user's adapter, called by SQL as a table function over each page's nodes."""
    pages = readable(spread(table(spark, sf_dir, "pages")))
    rows = with_urls(nodes(pages), pages)
    register(spark, [_link_lists()], "adapt_link_lists")
    rows.createOrReplaceTempView("lectern_page_nodes")
    return spark.sql("SELECT page_id, adapter, at AS place, text FROM adapt_link_lists(TABLE(lectern_page_nodes) PARTITION BY page_id ORDER BY seq)")


@query()
def page_utterances(spark, sf_dir):
    return speechify(_extracted(spark, sf_dir))


@query()
def page_stats(spark, sf_dir):
    pages = _extracted(spark, sf_dir)
    return stats(pages, speechify(pages))


@query(
    f"""SELECT doc_id AS page_id, CAST(len(list_filter([{_collapse_sql("coalesce(text, '') || ' ' || lang")}, {_collapse_sql("source")}], lambda t: t <> '')) AS INTEGER) AS paragraphs, array_to_string(list_filter([{_collapse_sql("coalesce(text, '') || ' ' || lang")}, {_collapse_sql("source")}], lambda t: t <> ''), '|') AS said, 'a b.pdf' AS title FROM documents"""
)
def pdf_items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = F.array(F.array(F.coalesce("text", F.lit("")), F.col("lang")), F.array("source"), F.array(F.lit("  ")))
    out = from_pdf(docs.select(F.col("doc_id").alias("page_id"), F.lit("https://x.example/d/a%20b.pdf?v=1").alias("url"), items.alias("page_items")))
    return out.select("page_id", F.size("blocks").alias("paragraphs"), F.array_join("blocks.text", "|").alias("said"), "title")


@query(f"SELECT conv_id * 1000 + turn AS page_id, length({_collapse_sql('text')}) > 20 AS ok, CASE WHEN length({_collapse_sql('text')}) > 20 THEN {_collapse_sql('text')} ELSE '' END AS said FROM conversations")
def selections(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return from_selection(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.lit("https://x.example/").alias("url"), F.col("text").alias("selection"))).select("page_id", "ok", F.array_join("blocks.text", "|").alias("said"))


# --- accounting --------------------------------------------------------------------------------------------------------

_LOG = "SELECT event_id, ts, user_id, CASE WHEN event_type = 'click' THEN 'free' ELSE 'pro' END AS model, event_type || ':' || CAST(user_id AS VARCHAR) AS key, CAST(event_id % 997 + 1 AS BIGINT) AS bytes FROM events"
_CACHE = f"SELECT key, max(bytes) AS bytes, min(ts) AS created_at, max(ts) AS last_used FROM ({_LOG}) GROUP BY key"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    model = F.when(F.col("event_type") == "click", "free").otherwise("pro")
    return events.select("event_id", "ts", "user_id", model.alias("model"), F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("key"), (F.col("event_id") % 997 + 1).alias("bytes"))


def _cache(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.max("bytes").alias("bytes"), F.min("ts").alias("created_at"), F.max("ts").alias("last_used"))


@query(f"SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) > 1 AS hit FROM ({_LOG})")
def cache_hits(spark, sf_dir):
    return A.hits_and_misses(_log(spark, sf_dir), "key", ["ts", "event_id"]).select("event_id", "key", "hit")


@query(
    f"""SELECT model, count(*) AS requests, CAST(sum(CASE WHEN hit THEN 0 ELSE bytes END) AS BIGINT) AS bytes_billed, CAST(sum(hit::INT) AS BIGINT) AS cache_hits,
    sum(CASE WHEN hit THEN 0 ELSE bytes END) / 1e6 * (CASE model WHEN 'pro' THEN 15.0 ELSE 0.0 END) AS cost, CAST(CASE model WHEN 'pro' THEN 15.0 ELSE 0.0 END AS DOUBLE) AS price
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) > 1 AS hit FROM ({_LOG})) GROUP BY model"""
)
def billing(spark, sf_dir):
    log = A.hits_and_misses(_log(spark, sf_dir), "key", ["ts", "event_id"])
    return A.with_cost(A.billed(log, ("model",)))


@query(f"SELECT key, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY last_used, key ROWS UNBOUNDED PRECEDING) AS cum, sum(bytes) OVER () AS total FROM ({_CACHE})) WHERE total - (cum - bytes) > 100000")
def cache_evicted(spark, sf_dir):
    return A.evicted(_cache(_log(spark, sf_dir)), 100_000).select("key", "bytes")


@query(f"SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) AS entries FROM ({_CACHE})")
def cache_size(spark, sf_dir):
    return A.size(_cache(_log(spark, sf_dir)))


@query(f"SELECT key, arg_max(bytes, (ts, event_id)) AS bytes, max(ts) AS created_at FROM ({_LOG}) GROUP BY key")
def cache_put(spark, sf_dir):
    log = _log(spark, sf_dir).select("key", F.col("ts").alias("created_at"), F.col("event_id").alias("last_used"), "bytes")
    return A.put(log.limit(0), log).select("key", "bytes", "created_at")


@query(
    f"""WITH old AS (SELECT key, bytes, epoch_ms(created_at) AS created_at, epoch_ms(last_used) AS last_used FROM ({_CACHE}) WHERE bytes > 300),
    w AS (SELECT key, bytes + 1000 AS bytes, row_number() OVER (ORDER BY ts, event_id) AS k FROM ({_LOG}) WHERE model = 'free'),
    m AS (SELECT count(*) // 25 * 25 AS n FROM w), base AS (SELECT max(last_used) AS t FROM old),
    early AS (SELECT key, arg_max(bytes, k) AS bytes, max(k) AS k FROM w, m WHERE k <= n GROUP BY key), late AS (SELECT key, arg_max(bytes, k) AS bytes FROM w, m WHERE k > n GROUP BY key),
    so_far AS (SELECT key, bytes, last_used FROM old WHERE key NOT IN (SELECT key FROM early) UNION ALL SELECT key, bytes, t + k FROM early, base),
    left_over AS (SELECT key, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY last_used, key ROWS UNBOUNDED PRECEDING) AS cum, sum(bytes) OVER () AS total FROM so_far) WHERE total - (cum - bytes) <= 200000)
    SELECT key, CAST(bytes AS BIGINT) AS bytes FROM left_over WHERE key NOT IN (SELECT key FROM late) UNION ALL SELECT key, CAST(bytes AS BIGINT) FROM late"""
)
def cache_put_filled(spark, sf_dir):
    """A put into a filled store whose keys it has in part, with a look at the budget after every 25th write."""
    log = _log(spark, sf_dir)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    old = _cache(log).filter("bytes > 300").select("key", "bytes", ms("created_at").alias("created_at"), ms("last_used").alias("last_used"))
    writes = log.filter("model = 'free'").select("key", (F.col("bytes") + 1000).alias("bytes"), "ts", "event_id")
    placed = A.running_total(writes.withColumn("one", F.lit(1)), "one", ["ts", "event_id"], name="k")
    base = old.agg(F.max("last_used")).first()[0] or 0
    fresh = stored(placed.select("key", "bytes", (F.col("k") + base).alias("created_at"), (F.col("k") + base).alias("last_used")), "writes")
    store = CacheStore(spark, shared_path(spark, "cache"), "key string, bytes long, created_at long, last_used long", budget=10**15)
    store.put(old, ["last_used", "key"])
    store.budget, store.pending = 200_000, 0
    store.put(fresh, ["created_at"])
    return store.read().select("key", "bytes")


@query(
    """WITH g AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g),
    k AS (SELECT user_id, burst, event_type, arg_max(event_id, (ts, event_id)) AS v, min(ts) AS began FROM b GROUP BY ALL)
    SELECT user_id, min(began) AS began, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS patch FROM k GROUP BY user_id, burst"""
)
def debounced_settings(spark, sf_dir):
    """Events read as patches of a user's settings, those of a burst as one."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("key"), F.col("event_id").alias("value"))
    entries = F.array_sort(F.transform(F.map_entries("patch"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return debounced(events, "12 hours", ("user_id",)).select("user_id", F.col("began").cast(table(spark, sf_dir, "events").schema["ts"].dataType).alias("began"), F.array_join(entries, ";").alias("patch"))


@query(f"SELECT doc_id, {_collapse_sql(_chain('text', [('=>', ' arrow '), ('===?', ' equals '), ('!==?', ' not equals '), ('&&', ' and '), ('[|][|]', ' or '), (r'[{}()\[\];]', ' '), ('_', ' underscore ')]))} AS code FROM documents")
def spoken_code(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", X.speakable_code(F.col("text")).alias("code"))


@query(f"SELECT event_id, l.key IN (SELECT key FROM ({_LOG}) WHERE model = 'free') AS hit FROM ({_LOG}) l")
def cache_lookup(spark, sf_dir):
    log = _log(spark, sf_dir)
    return A.against_cache(log, log.filter("model = 'free'")).select("event_id", "hit")


@query(f"SELECT model, count(*) AS missing FROM ({_LOG}) WHERE key NOT IN (SELECT key FROM ({_CACHE}) WHERE bytes > 500) GROUP BY model")
def cache_missing(spark, sf_dir):
    log = _log(spark, sf_dir)
    return A.missing(log, _cache(log).filter("bytes > 500")).groupBy("model").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT conv_id, turn, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), ',') AS ahead FROM conversations")
def look_ahead(spark, sf_dir):
    return A.look_ahead(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.array_join(F.transform("window_seqs", lambda x: x.cast("string")), ",").alias("ahead"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id) AS progress FROM conversations")
def progress(spark, sf_dir):
    return A.progress(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "progress")


@query("SELECT conv_id, count(*) || ':' || sum(strlen(text)) || ':v:' || 'pro' AS signature FROM conversations GROUP BY conv_id")
def queue_signatures(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("bytes", X.utf8_bytes(F.col("text")))
    return A.queue_signature(turns, "conv_id", F.lit("v"), F.lit("pro"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY abs(turn - 2), turn DESC) AS k FROM conversations) WHERE k > 6")
def out_of_memory(spark, sf_dir):
    held = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(2).alias("head"))
    return A.out_of_memory(held, "conv_id", "turn", "head").drop("head")


@query("SELECT conv_id, turn, sha256('[' || CAST(to_json(text) AS VARCHAR) || ',\"v\",\"pro\",1,0]') AS key FROM conversations")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.cache_key(F.col("text"), F.lit("v"), F.lit("pro")).alias("key"))


_VOICES = "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, s_acctbal AS score, CAST(floor(s_acctbal) AS BIGINT) AS likes, CASE WHEN s_nationkey % 5 = 0 THEN 'asr' ELSE 'tts' END AS type, CASE WHEN s_nationkey % 7 = 0 THEN 'training' ELSE 'trained' END AS state, s_nationkey FROM supplier"


def _voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("score"), F.floor("s_acctbal").alias("likes"), F.when(n % 5 == 0, "asr").otherwise("tts").alias("type"), F.when(n % 7 == 0, "training").otherwise("trained").alias("state"), "s_nationkey")


@query(f"SELECT id, title, score FROM ({_VOICES}) WHERE type = 'tts' AND state = 'trained' ORDER BY score DESC NULLS LAST, id LIMIT 10 OFFSET 10")
def voices_page(spark, sf_dir):
    return A.voices(_voices(spark, sf_dir), page_size=10, page=2).select("id", "title", "score")


@query(
    f"""WITH p AS (SELECT 'language' AS probe, 0 AS seq, * FROM ({_VOICES}) WHERE s_nationkey < 15 UNION ALL SELECT 'title', 1, * FROM ({_VOICES}) WHERE s_nationkey > 8)
    SELECT id, arg_min(title, seq) AS title, arg_min(likes, seq) AS likes, string_agg(probe, ',' ORDER BY seq) AS matched_by FROM p GROUP BY id"""
)
def voices_merged(spark, sf_dir):
    v, n = _voices(spark, sf_dir), F.col("s_nationkey")
    probe = lambda rows, name, seq: rows.select(F.lit(name).alias("probe"), F.lit(seq).alias("seq"), "id", "title", "likes")
    both = probe(v.filter(n < 15), "language", 0).unionByName(probe(v.filter(n > 8), "title", 1))
    return A.merged_voices(both).select("id", "title", "likes", F.array_join("matched_by", ",").alias("matched_by"))


@query("SELECT o_orderkey, (o_orderkey % 700) = 429 OR (o_orderkey % 700) BETWEEN 500 AND 599 AS retry FROM orders")
def retryable(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", A.retryable(F.col("o_orderkey") % 700).alias("retry"))


# --- more of the cache, the player and the labels --------------------------------------------------------------------


@query(f"SELECT key, greatest(created_at, free) AS last_used, bytes FROM ({_CACHE}) LEFT JOIN (SELECT key, max(ts) AS free FROM ({_LOG}) WHERE model = 'free' AND event_id % 2 = 0 GROUP BY key) USING (key)")
def cache_touched(spark, sf_dir):
    log = _log(spark, sf_dir)
    cache = _cache(log).select("key", F.col("created_at").alias("last_used"), "bytes")
    return A.touched(cache, log.filter("model = 'free' AND event_id % 2 = 0").select("key", F.col("ts").alias("at")))


@query(f"SELECT event_id, key FROM ({_LOG}) WHERE key IN (SELECT key FROM ({_CACHE}) WHERE bytes > 500)")
def cache_has(spark, sf_dir):
    log = _log(spark, sf_dir)
    return A.has(log, _cache(log).filter("bytes > 500")).select("event_id", "key")


@query(
    f"""WITH c AS ({_CACHE}), old AS (SELECT key FROM (SELECT *, sum(bytes) OVER (ORDER BY last_used, key ROWS UNBOUNDED PRECEDING) AS cum, sum(bytes) OVER () AS total FROM c) WHERE total - (cum - bytes) > 50000)
    SELECT key, bytes FROM c WHERE key NOT IN (SELECT key FROM old) UNION ALL SELECT 'new:' || key, bytes FROM c WHERE bytes < 300"""
)
def cache_put_over_quota(spark, sf_dir):
    """Stores new keys into a full cache, which makes room first."""
    cache = _cache(_log(spark, sf_dir))
    rows = cache.filter("bytes < 300").withColumn("key", F.concat(F.lit("new:"), "key"))
    return A.put_over_quota(cache, rows, 100_000).select("key", "bytes")


@query("SELECT DISTINCT user_id, event_type FROM events")
def in_flight(spark, sf_dir):
    return A.in_flight(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")


@query(
    """SELECT o_orderkey, CASE s WHEN 401 THEN 'key' WHEN 402 THEN 'balance' WHEN 429 THEN 'rate' ELSE CASE WHEN s >= 500 AND s < 600 THEN 'server' ELSE 'other' END END AS hint
    FROM (SELECT o_orderkey, o_orderkey % 700 AS s FROM orders)"""
)
def error_hints(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", A.error_hint(F.col("o_orderkey") % 700).alias("hint"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, coalesce(CASE WHEN s_nationkey % 3 > 0 THEN s_name END, 'Untitled') AS title, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN 'en,hi' END, '') AS languages,
    coalesce(CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey END, 0) AS likes, coalesce(CASE WHEN s_nationkey > 4 THEN s_name END, '') AS author, CASE WHEN s_nationkey % 2 = 0 THEN 'https://x.example/' || s_suppkey END AS sample FROM supplier"""
)
def voices_normalized(spark, sf_dir):
    n, none = F.col("s_nationkey"), F.array().cast("array<string>")
    raw = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.when(n % 3 > 0, F.col("s_name")).alias("title"), F.when(n % 2 == 0, F.array(F.lit("en"), F.lit("hi"))).alias("languages"), none.alias("tags"),
        F.when(n % 4 > 0, n).alias("likes"), F.lit(0).alias("tasks"), F.when(n > 4, F.col("s_name")).alias("author"), F.lit(None).cast("string").alias("description"),
        F.concat(F.when(n % 2 == 0, "https://x.example/").otherwise("javascript:"), F.col("s_suppkey").cast("string")).alias("sample_url"),
    )
    return A.normalized_voices(raw).select("id", "title", F.array_join("languages", ",").alias("languages"), "likes", "author", A.safe_sample(F.col("sample_url")).alias("sample"))


_RUNGS = ", ".join(map(str, X.SPEEDS))


@query(
    f"""WITH s AS (SELECT o_orderkey, (o_orderkey % 300) / 100.0 AS speed FROM orders), r AS (SELECT unnest([{_RUNGS}]::DOUBLE[]) AS rung, unnest(range(1, {len(X.SPEEDS)} + 1)) AS i),
    l AS (SELECT list(rung ORDER BY i) AS rungs FROM r), a AS (SELECT o_orderkey, coalesce(min(i) FILTER (WHERE abs(rung - speed) < 0.001), min(i) FILTER (WHERE rung >= speed), {len(X.SPEEDS)}) AS i FROM s, r GROUP BY o_orderkey)
    SELECT o_orderkey, rungs[least(greatest(i + 1, 1), {len(X.SPEEDS)})] AS faster, rungs[least(greatest(i - 1, 1), {len(X.SPEEDS)})] AS slower FROM a, l"""
)
def speeds(spark, sf_dir):
    speed = (F.col("o_orderkey") % 300) / 100.0
    return table(spark, sf_dir, "orders").select("o_orderkey", X.nudge_speed(speed, 1).cast("double").alias("faster"), X.nudge_speed(speed, -1).cast("double").alias("slower"))


@query(
    f"""SELECT conv_id, turn, {_collapse_sql("text || ' pause ' || role")} AS shown, CASE role WHEN 'user' THEN 'quote' WHEN 'assistant' THEN 'plain' ELSE 'skipped' END AS class,
    CASE WHEN n = 0 THEN '' WHEN floor(n / 60 + 0.5) < 1 THEN 'under a minute' ELSE CAST(CAST(floor(n / 60 + 0.5) AS BIGINT) AS VARCHAR) || ' min listen' END AS lasts
    FROM (SELECT *, CAST(coalesce(length(text), 0) AS DOUBLE) AS n FROM conversations)"""
)
def displayed_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "quote").when(F.col("role") == "assistant", "paragraph").otherwise("code")
    marked = F.concat("text", F.lit(" [break] pause [long-break] "), "role")
    return turns.select("conv_id", "turn", X.display_text(marked).alias("shown"), X.display_class(kind).alias("class"), X.duration_label(F.coalesce(F.char_length("text"), F.lit(0))).alias("lasts"))


@query(
    """SELECT o_orderkey, format('{:,}', b) || ' bytes · ' || CASE WHEN p = 0 THEN 'free model' WHEN b / 1e6 * p > 0 AND b / 1e6 * p < 0.01 THEN 'under a cent' ELSE '$' || printf('%.3f', b / 1e6 * p) END
      || CASE WHEN r > 0 THEN ' · ' || r || ' reused' ELSE '' END AS cost,
    CASE r WHEN 0 THEN 'Sentence ' || (i + 1) || ' of 40' WHEN 1 THEN 'Paused · ' || (i + 1) || ' of 40' WHEN 2 THEN 'Buffering audio…' ELSE '40 sentences ready' END AS status
    FROM (SELECT o_orderkey, CAST(o_orderkey * 37 % 100000 AS BIGINT) AS b, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 15.0 END::DOUBLE AS p, o_orderkey % 4 AS r, o_orderkey % 40 AS i FROM orders)"""
)
def player_labels(spark, sf_dir):
    n = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("playing", "paused", "buffering", "idle"))), (n % 4 + 1).cast("int"))
    cost = X.cost_label((n * 37 % 100_000).cast("long"), F.when(n % 2 == 0, 0.0).otherwise(15.0), n % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", cost.alias("cost"), X.status_label(status, n % 40, F.lit(40)).alias("status"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || chr(13) || chr(10) || chr(13) || 'end  ' || chr(10), '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS code,
    coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN 'pt-BR' END), ''), nullif(lang, ''), 'en') AS first FROM documents"""
)
def cleaned_code(spark, sf_dir):
    """Texts read as code, and the language that the first non-blank source names."""
    source = F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, " pt-BR , en")
    code = X.clean_code(F.concat("text", F.lit("\r\n\rend  \n")))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), X.detect_lang(source, F.col("lang")).alias("first"))


@query(f"SELECT doc_id, instr({_collapse_sql('text')}, substr({_collapse_sql('substr(text, 30, 90)')}, 1, 40)) - 1 AS place FROM documents")
def aligned_sentences(spark, sf_dir):
    """Where a spoken part of a text stands in it."""
    said = F.concat(F.lit("[long-break] "), F.substring("text", 30, 90), F.lit(" [break]"))
    return _texts(spark, sf_dir).select("doc_id", X.align_sentence(F.col("text"), said).cast("long").alias("place"))


@query(
    """SELECT n_nationkey, 'Table with 2 rows. Row 1: Name, ' || n_name || CASE WHEN n_nationkey % 3 > 0 THEN '; Key, ' || n_nationkey ELSE '' END || '. Row 2: Name, x; Key, ' || n_regionkey || '; tail.' AS said,
    'Table. ' || n_name AS plain FROM nation"""
)
def read_tables(spark, sf_dir):
    """Tables read with each cell under its header, and without cells."""
    key = F.col("n_nationkey").cast("string")
    head, one = F.array(F.lit("Name"), F.lit("Key"), F.lit("")), F.array(F.concat(F.lit(" "), "n_name"), F.when(F.col("n_nationkey") % 3 > 0, key).otherwise(" "))
    cells = F.array(head, one, F.array(F.lit("x"), F.col("n_regionkey").cast("string"), F.lit("tail ")))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.linearize_table(F.col("n_name"), cells).alias("said"), X.linearize_table(F.col("n_name"), F.lit(None).cast("array<array<string>>")).alias("plain"))


@query(
    f"""SELECT page_id, k, list_contains([{', '.join(repr(u) for u in X.UNREADABLE)}], start) AS blocked FROM pages, (SELECT unnest([{', '.join(repr(u) for u in X.UNREADABLE)}, 'https://x.example/', '']) AS start, unnest(range({len(X.UNREADABLE)} + 2)) AS k)"""
)
def blocked_addresses(spark, sf_dir):
    """Every kind of address that is never read, and two that are."""
    starts = F.array(*map(F.lit, (*X.UNREADABLE, "https://x.example/", "")))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(starts).alias("k", "start")).select("page_id", F.col("k").cast("long").alias("k"), X.blocked_url(F.concat("start", F.col("page_id").cast("string"))).alias("blocked"))
