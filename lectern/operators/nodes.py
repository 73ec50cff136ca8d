"""Pages as a table of nodes.

The only row-by-row Python of extraction is here: a page's markup becomes one row for each element and piece of text, in
reading order, with its parent, the element before it, its NEAR innermost ancestors and the end of its subtree. Everything
else is joins, windows and sums over these rows: an element is inside another if its number lies between the other's number
and end. A row is of bounded size but for its text, however deep a page is nested, and parsing takes linear time.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd mark q ruby rt rp s samp small span strong sub sup time u var wbr font nobr big tt".split())
#: What stands in place of a tag: text of the page, and line ends between blocks that only speech needs.
TEXT, SEPARATOR = "#text", "#separator"
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Which open tags an opening tag ends, up to the given borders.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Ancestors that a row names, itself included.
NEAR = 8
#: How many rows of pages go to Spark together, at least; those of one page always do.
ROWS_TOGETHER = 4096
NODE_SCHEMA = "page_id long, seq int, end int, parent int, before int, near array<int>, is_text boolean, tag string, attrs map<string,string>, text string, t_from int, t_to int, in_row int, in_cell int"
END, PARENT, BEFORE, NEARS, IS_TEXT, TAG, ATTRS, WORDS, FROM, TO, ROW, CELL = range(12)


class _Rows(HTMLParser):
    """Rows of NODE_SCHEMA's columns after the first two, in reading order; their places are their numbers. t_from and t_to
    number the pieces of text: those of an element are t_from up to t_to."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        #: Places in `open` of each tag, and the last child element of each open element and of the page.
        self.places: dict[str, list[int]] = {}
        self.last: list[int | None] = [None]
        self.texts = 0
        self.feed(html)
        self.close()
        while self.open:
            self._end()

    def _add(self, is_text: bool, tag: str, attrs: dict | None, text: str | None) -> int:
        at, up = len(self.rows), self.open[-1] if self.open else None
        row, cell = (self.rows[up][ROW], self.rows[up][CELL]) if self.open else (None, None)
        if not is_text:
            row, cell = at if tag == "tr" else row, at if tag in ("td", "th") else cell
        before, near = (None, None) if is_text else (self.last[-1], [*self.open[-(NEAR - 1) :], at])
        if not is_text:
            self.last[-1] = at
        self.rows.append([at + 1, up, before, near, is_text, tag, attrs, text, self.texts, self.texts + (tag == TEXT), row, cell])
        self.texts += tag == TEXT
        return at

    def _text(self, text: str, tag: str = SEPARATOR) -> None:
        self._add(True, tag, None, text)

    def _end(self) -> None:
        k = self.open[-1]
        if self.rows[k][TAG] not in INLINE:
            self._text("\n")
        self.open.pop()
        self.last.pop()
        self.places[self.rows[k][TAG]].pop()
        self.rows[k][END], self.rows[k][TO] = len(self.rows), self.texts

    def _place(self, tags) -> int:
        top = -1
        for tag in tags:
            places = self.places.get(tag)
            if places and places[-1] > top:
                top = places[-1]
        return top

    def _end_to(self, names, borders) -> None:
        at = self._place(names)
        if at >= 0 and at > self._place(borders):
            while len(self.open) > at:
                self._end()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSE_P:
            self._end_to(("p",), ("button", "td", "th", "table", "caption", "object"))
        if tag in ENDS:
            self._end_to(*ENDS[tag])
        at = self._add(False, tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag in VOID:
            if tag == "br":
                self._text("\n")
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(at)
        self.last.append(None)
        if tag not in INLINE:
            self._text("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and self.open and self.rows[self.open[-1]][TAG] == tag and tag in ("svg", "path", "embed"):
            self._end()

    def handle_endtag(self, tag):
        self._end_to((tag,), ())

    def handle_data(self, data):
        if data:
            self._text(data, TEXT)


def nodes(pages: DataFrame) -> DataFrame:
    """NODE_SCHEMA rows of `pages` (page_id, html). Markup that can't be read gives no rows."""

    def work(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), *[pa.int32()] * 4]
        names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]

        def together(ids, seqs, rows):
            cols = [*zip(*rows, strict=True)] or [[] for _ in kinds]
            cols[ATTRS] = [None if m is None else [*m.items()] for m in cols[ATTRS]]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.int32()), *arrays], names)

        ids, seqs, held = [], [], []
        for batch in batches:
            for page_id, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
                try:
                    rows = _Rows(html.as_py() or "").rows
                except (AssertionError, ValueError):
                    rows = []
                ids += [page_id.as_py()] * len(rows)
                seqs += range(len(rows))
                held += rows
                if len(held) >= ROWS_TOGETHER:
                    yield together(ids, seqs, held)
                    ids, seqs, held = [], [], []
        yield together(ids, seqs, held)

    return pages.select("page_id", "html").mapInArrow(work, NODE_SCHEMA)


def attr(name: str) -> Column:
    """An attribute of an element, '' if it has none."""
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_class(name: str) -> Column:
    return F.array_contains(F.split(attr("class"), r"\s+"), name)
