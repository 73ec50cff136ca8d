"""Where a spoken sentence stands on its page: the piece of text that its beginning is in, and the place in it.

The texts of an element, one after the other as they are in the markup, are searched for the sentence's first letters. The
pieces' starts are prefix sums of lengths over the page, so the place found is a number in the page's text, and the piece it
is in is the last that begins at or before it: one ordered pass over pieces and places together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse
from lectern.operators.adapters import whole_text
from lectern.operators.nodes import TEXT

#: Shortest sentence that is looked for, and how many of its characters are.
LEAST, LOOKED_FOR = 4, 40


def sentence_places(spoken: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of `spoken` (page_id, key, uid, text) those whose text is found in their element: (page_id, key, node, piece, start,
    end). node is a text's number on its page, piece its number in its element, start and end places in it, the end not
    past it. `nodes` have stamps. Marks for pauses are no part of a sentence; the first of equal places counts."""
    clean = collapse(F.regexp_replace("text", r"\[(?:long-)?break\]", ""))
    said = spoken.withColumns({"clean": clean, "stamp": F.expr("try_cast(substr(uid, 2) AS INT)")}).filter((F.char_length("clean") >= LEAST) & F.col("stamp").isNotNull())
    marked = nodes.filter("stamp IS NOT NULL").select("page_id", "stamp", "t_from", "t_to")
    wanted = marked.join(said.select("page_id", "stamp").distinct(), ["page_id", "stamp"], "left_semi")
    raw = whole_text(nodes, wanted).select("page_id", "stamp", F.col("t_from").alias("first"), "raw")
    at = F.expr(f"instr(raw, substr(clean, 1, {LOOKED_FOR})) - 1")
    found = said.join(raw, ["page_id", "stamp"]).withColumn("at", at).filter("at >= 0")

    before = Window.partitionBy("page_id").orderBy("t_from").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("text")
    pieces = nodes.filter(F.col("tag") == TEXT).select("page_id", F.col("seq").alias("node"), "t_from", size.alias("size"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("begins"))
    base = pieces.select("page_id", F.col("t_from").alias("first"), F.col("begins").alias("base"))
    places = found.join(base, ["page_id", "first"]).select("page_id", (F.col("base") + F.col("at")).alias("place"), F.struct("key", "first", F.char_length("clean").alias("length")).alias("asked"))
    both = pieces.select("page_id", F.col("begins").alias("place"), F.struct("node", "t_from", "begins", "size").alias("piece")).unionByName(places, allowMissingColumns=True)
    # A piece stands before what is looked for at its very beginning.
    order = Window.partitionBy("page_id").orderBy("place", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("piece", F.last("piece", ignorenulls=True).over(order)).filter("asked IS NOT NULL")
    start = F.col("place") - F.col("piece.begins")
    return held.select("page_id", "asked.key", "piece.node", (F.col("piece.t_from") - F.col("asked.first")).alias("piece"), start.cast("int").alias("start"), F.least(start + F.col("asked.length"), F.col("piece.size")).cast("int").alias("end"))
