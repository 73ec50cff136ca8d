"""Content that style sheets hide."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.nodes import nodes
from lectern.operators.sheets import with_sheets

#: Style sheet, markup, and the ids of what is hidden.
CASES = [
    (".gone{display:none}", "<p id=a class='x gone'>t</p><p id=b class=x>t</p>", "a"),
    ("p{color:red;visibility: hidden }", "<p id=a>t</p><div id=b>t</div>", "a"),
    (".m li{display:none} .m > i { display : NONE }", "<ul id=u class=m><li id=a><i id=b>t</i></li></ul><div class=m><i id=c>t</i></div><li id=d>t</li>", "a c"),
    ("#a.b, .q{display:none!important}", "<p id=a class=b style='display:block'>t</p><p id=b class=q>t</p><p id=c class=b>t</p>", "a b"),
    (".x{display:none}.x{display:block}", "<p id=a class=x>t</p>", ""),
    ("#a{display:none}.x{display:block}p{display:inline}", "<p id=a class=x>t</p>", "a"),
    (".x{display:none}", "<p id=a class=x style='display:block'>t</p><p id=b class=x style='color:red'>t</p>", "b"),
    (".s{position:absolute;clip:rect(0px, 0px, 0px, 0px)}.p{position:absolute}.c{clip-path:inset(50%)}", "<p id=a class=s>t</p><p id=b class=p>t</p><p id=c class=c>t</p><p id=d class='p c'>t</p>", "a d"),
    ("@media print{.x{display:none}} /* .y{display:none} */ .z{display:none}", "<p id=a class=x>t</p><p id=b class=y>t</p><p id=c class=z>t</p>", "c"),
    ("a:hover{display:none} [x]{display:none} .k{opacity:0}", "<a id=a x=1 class=k>t</a>", ""),
    (".a .b .c{display:none}", "<div class=a><div class=b><p id=x class=c>t</p></div><p id=y class=c>t</p></div><div class=b><p id=z class=c>t</p></div>", "x"),
    ("*{visibility:collapse}", "<p id=a>t</p>", "a"),
]


@pytest.fixture(scope="module")
def hidden(spark):
    pages = spark.createDataFrame([(k, f"<head><style>p{{margin:0}}</style><style>{css}</style></head><body>{html}</body>") for k, (css, html, _) in enumerate(CASES)], "page_id long, html string")
    rows = with_sheets(nodes(pages)).filter(F.map_contains_key("attrs", "hidden") & F.map_contains_key("attrs", "id")).select("page_id", F.col("attrs")["id"].alias("id")).collect()
    return {k: sorted(r.id for r in rows if r.page_id == k) for k in range(len(CASES))}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_hidden(hidden, k):
    assert hidden[k] == CASES[k][2].split()


def test_pages_without_rules(spark):
    rows = nodes(spark.createDataFrame([(1, "<style>p{margin:0}</style><p>t</p>"), (2, None)], "page_id long, html string"))
    assert with_sheets(rows).columns == rows.columns and with_sheets(rows).count() == rows.count()
