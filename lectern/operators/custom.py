"""Adapters that users write: a table function over the nodes of a page, which SQL can call as well.

An adapter says whether a page is its own and what its blocks are. The function gets each page's nodes in order, as one
partition of its table argument, and tries the adapters in the order of their list: the first that matches and gives blocks
with text wins; one that gives none, or fails, yields to the next. Pages that no adapter reads give no rows, and go on to
the adapters of the library.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lectern.functions.text import clean_code, collapse
from lectern.operators.nodes import SEPARATOR, TEXT
from lectern.schema import KINDS

#: What a table function is told of a node, and of how much markup its part of the pages is at most, but for one page.
NODE_COLUMNS = ("page_id", "seq", "end", "parent", "tag", "attrs", "text")
PART_BYTES = 2 << 20
BLOCKS_SCHEMA = "page_id long, adapter string, at int, kind string, level int, text string, seq int"


class Node:
    """An element, or a piece of text."""

    __slots__ = ("attrs", "end", "parent", "seq", "tag", "text")

    def __init__(self, seq: int, end: int, parent: int | None, tag: str, attrs: dict[str, str] | None, text: str | None):
        self.seq, self.end, self.parent, self.tag, self.attrs, self.text = seq, end, parent, tag, attrs or {}, text

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Page:
    """The nodes of one page in reading order, by number."""

    def __init__(self, page_id: int, nodes: dict[int, Node]):
        self.page_id, self.nodes = page_id, nodes

    def elements(self, tag: str | None = None, cls: str | None = None, id: str | None = None, inside: Node | None = None) -> Iterator[Node]:
        for n in self.below(inside):
            if n.tag not in (TEXT, SEPARATOR) and (tag is None or n.tag == tag) and (cls is None or cls in n.classes()) and (id is None or n.attrs.get("id") == id):
                yield n

    def below(self, node: Node | None) -> Iterator[Node]:
        if node is None:
            yield from self.nodes.values()
        else:
            yield from (self.nodes[k] for k in range(node.seq + 1, node.end) if k in self.nodes)

    def text_of(self, node: Node) -> str:
        return "".join(n.text or "" for n in self.below(node) if n.tag == TEXT)


class PageAdapter(Protocol):
    name: str

    def match(self, url: str, page: Page) -> bool: ...

    #: Blocks as mappings with text, and kind, level and node, the element they are from, where they have them.
    def extract(self, page: Page, url: str) -> Iterable[dict[str, Any]] | None: ...


def adapter_function(adapters: Sequence[PageAdapter]):
    """The table function of a list of adapters: BLOCKS_SCHEMA rows of TABLE(url and node columns) PARTITION BY page_id
    ORDER BY seq. Its state is one page."""

    class Adapt:
        def __init__(self):
            self.page_id, self.url, self.nodes = None, "", {}

        def eval(self, row):
            self.page_id, self.url = row["page_id"], row["url"] or ""
            self.nodes[row["seq"]] = Node(row["seq"], row["end"], row["parent"], row["tag"], row["attrs"], row["text"])

        def terminate(self):
            page = Page(self.page_id, self.nodes)
            for a in adapters:
                try:
                    found = [b for b in (a.extract(page, self.url) or ()) if (b.get("text") or "").strip()] if a.match(self.url, page) else []
                except Exception:  # noqa: BLE001 - an adapter that fails yields to the next
                    found = []
                if found:
                    for k, b in enumerate(found):
                        node = b.get("node")
                        yield self.page_id, getattr(a, "name", "unnamed"), k, b.get("kind") or "paragraph", b.get("level"), b["text"], node.seq if node else None
                    return

    return udtf(Adapt, returnType=BLOCKS_SCHEMA)


def with_urls(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """NODE_COLUMNS and url of the nodes of `pages` (page_id, url, html), dealt by page to parts of bounded size: each part is
    sorted by one task, whose memory would grow with the pages if their number of parts did not."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return nodes.select(*NODE_COLUMNS).repartition(parts, "page_id").join(pages.select("page_id", "url"), "page_id")


def register(spark: SparkSession, adapters: Sequence[PageAdapter], name: str = "adapt_pages") -> None:
    """Makes the adapters callable as SELECT * FROM name(TABLE(nodes) PARTITION BY page_id ORDER BY seq)."""
    spark.udtf.register(name, adapter_function(adapters))


def adapted(nodes: DataFrame, pages: DataFrame, adapters: Sequence[PageAdapter]) -> DataFrame:
    """(page_id, source, adapter, at, kind, level, text, seq) of the pages (page_id, url) that one of `adapters` reads. Kinds
    that aren't known are paragraphs; texts are collapsed, code is cleaned, and what is empty then goes."""
    rows = nodes.join(pages.select("page_id", "url"), "page_id").select("page_id", "url", "seq", "end", "parent", "tag", "attrs", "text")
    found = adapter_function(adapters)(rows.asTable().partitionBy("page_id").orderBy("seq"))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("paragraph")
    text = F.when(F.col("kind") == "code", clean_code(F.col("text"))).otherwise(collapse(F.col("text")))
    return found.withColumn("kind", kind).withColumn("text", text).filter("text <> ''").withColumn("source", F.lit("custom"))
