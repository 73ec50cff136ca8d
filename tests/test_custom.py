"""Adapters that users write."""

import pytest

from lectern.operators.custom import PART_BYTES, register, with_urls
from lectern.operators.extract import extract
from lectern.operators.nodes import nodes


def adapters():
    """Classes of this function go to the workers as they are; those of a module would have to be there."""

    class Recipes:
        """Recipes by their list of steps."""

        name = "recipes"

        def match(self, url, page):
            return "/recipe/" in url

        def extract(self, page, url):
            steps = next(page.elements(cls="steps"), None)
            if steps is None:
                return None
            title = next(page.elements(tag="h1"), None)
            head = [{"kind": "heading", "level": 1, "text": page.text_of(title), "node": title}] if title else []
            return head + [{"kind": "list-item", "text": page.text_of(n), "node": n} for n in page.elements(tag="li", inside=steps)]

    class Broken(Recipes):
        name = "broken"

        def extract(self, page, url):
            raise RuntimeError("no")

    class Rest:
        name = "rest"

        def match(self, url, page):
            return any(page.elements(id="rest"))

        def extract(self, page, url):
            return [{"kind": "odd", "text": " rest  of it "}, {"text": " "}, {"kind": "code", "text": "a  \n\n\n\nb"}]

    return Broken(), Recipes(), Rest()


PAGES = [
    (1, "https://x.example/recipe/1", "<h1>Soup</h1><ol class='steps'><li>Boil it.</li><li>Stir <b>it</b> well.</li></ol><p>An ad for pans.</p>"),
    (2, "https://x.example/recipe/2", "<div id='rest'>x</div>"),
    (3, "https://x.example/recipe/3", "<body>" + "<p>No list of steps is on this page, so others may read it if they can.</p>" * 4),
    (4, "https://en.wikipedia.org/wiki/recipe/X", "<div class='mw-parser-output'><p>Soup is a dish.</p></div>"),
    (5, "https://en.wikipedia.org/recipe/Y", "<h1>Own</h1><div class='mw-parser-output'><ul class='steps'><li>First of all.</li></ul></div>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_the_first_that_gives_blocks_wins(spark, pages):
    got = {r.page_id: r for r in extract(pages, adapters=adapters()).collect()}
    said = {k: (r.strategy, [(b.kind, b.level, b.text) for b in r.blocks]) for k, r in got.items()}
    assert said[1] == ("adapter:recipes", [("heading", 1, "Soup"), ("list-item", None, "Boil it."), ("list-item", None, "Stir it well.")])
    assert all(b.uid for b in got[1].blocks) and [b.id for b in got[1].blocks] == ["b0", "b1", "b2"]
    assert said[2] == ("adapter:rest", [("paragraph", None, "rest of it"), ("code", None, "a\n\nb")])
    assert said[3][0] in ("density", "readability") and said[4] == ("adapter:wikipedia", [("paragraph", None, "Soup is a dish.")])
    assert said[5][0] == "adapter:recipes"


def test_sql(spark, pages):
    register(spark, adapters())
    nodes(pages).join(pages.select("page_id", "url"), "page_id").createOrReplaceTempView("page_nodes")
    got = spark.sql("SELECT page_id, adapter, count(*) AS n FROM adapt_pages(TABLE(page_nodes) PARTITION BY page_id ORDER BY seq) GROUP BY ALL").collect()
    assert {(r.page_id, r.adapter, r.n) for r in got} == {(1, "recipes", 3), (2, "rest", 2), (5, "recipes", 2)}


def test_parts_of_pages_are_of_bounded_size(spark):
    """Pages were sorted in as many parts as the session has for shuffles, so that a task's memory grew with the table."""
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(k, "https://x.example/", "<p>short") for k in range(40)], "page_id long, url string, html string")
    long = few.withColumn("html", F.concat(F.lit("<p>"), F.repeat(F.lit("prose "), PART_BYTES // 24)))
    parts = lambda pages: with_urls(nodes(pages), pages).select("page_id", "url", F.spark_partition_id().alias("part")).distinct().collect()
    assert max(r.part for r in parts(few)) < spark.sparkContext.defaultParallelism
    got = parts(long)
    assert len(got) == 40 and len({r.part for r in got}) > spark.sparkContext.defaultParallelism and {r.url for r in got} == {"https://x.example/"}
