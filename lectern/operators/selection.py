"""Blocks of a selected range of a page, from its two boundary points.

A range (from_piece, from_at, to_piece, to_at) goes from a place in one piece of text to a place in another, both by number
on their page. What is read is what copying the range gives: the elements below the innermost one that holds both ends, as
far as they reach into the range, with the first and last text cut. That element itself is not copied; its place takes a
plain div. So node rows are clipped by their intervals before blocks are built, and blocks are built as from any container.

A range within one text copies no element: then the text is read as one paragraph, under the id of the nearest element
around it that has one. Ranges of at most MIN_SELECTION collapsed characters, that end before they begin, or name pieces
that aren't there give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapse
from lectern.operators.blocks import blocks_from, gathered
from lectern.operators.nodes import TEXT
from lectern.plans.storage import stored
from lectern.schema import META
from lectern.sources.tables import MIN_SELECTION

RANGE = "struct<from_piece:int,from_at:int,to_piece:int,to_at:int>"


def clipped(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Node rows that the ranges (page_id, range) reach, texts cut to them; c_seq and c_end are the element around."""
    first, last = F.col("range.from_piece"), F.col("range.to_piece")
    text = F.col("tag") == TEXT
    rows = nodes.join(ranges, "page_id")
    at = lambda piece: F.max(F.when(text & (F.col("t_from") == piece), F.col("seq")))
    ends = rows.groupBy("page_id").agg(at(first).alias("a"), at(last).alias("z")).filter("a <= z")
    around = rows.join(ends, "page_id").filter((~F.col("is_text")) & (F.col("seq") < F.col("a")) & (F.col("end") > F.col("z")))
    around = around.groupBy("page_id").agg(F.max(F.struct("seq", "end")).alias("c"), F.first("a").alias("a"), F.first("z").alias("z"))
    held = rows.join(around, "page_id").filter((F.col("seq") == F.col("c.seq")) | ((F.col("seq") > F.col("c.seq")) & (F.col("seq") <= F.col("z")) & (F.col("end") > F.col("a"))))
    size = F.char_length("text")
    start = F.when(F.col("t_from") == first, F.least(F.col("range.from_at"), size)).otherwise(0)
    stop = F.when(F.col("t_from") == last, F.least(F.col("range.to_at"), size)).otherwise(size)
    root = F.col("seq") == F.col("c.seq")
    plain = {
        "text": F.when(text, F.expr("substr(text, __start + 1, greatest(__stop - __start, 0))")).otherwise(F.col("text")),
        "tag": F.when(root, "div").otherwise(F.col("tag")),
        "attrs": F.when(root, F.create_map().cast("map<string,string>")).otherwise(F.col("attrs")),
        "stamp": F.when(~root, F.col("stamp")),
        # A copy has no ancestors above it.
        "near": F.filter("near", lambda k: k >= F.col("c.seq")),
    }
    cut = held.withColumns({"__start": start, "__stop": stop}).withColumns(plain)
    return cut.select(*nodes.columns, F.col("c.seq").alias("c_seq"), F.col("c.end").alias("c_end"))


def selected_blocks(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(page_id, blocks) of the ranges (page_id, range) over node rows with stamps."""
    rows = stored(clipped(nodes, ranges), "clipped")
    order = F.array_sort(F.collect_list(F.when(F.col("is_text"), F.struct("seq", "text"))))
    said = rows.groupBy("page_id", "c_seq", "c_end").agg(collapse(F.array_join(F.transform(order, lambda p: p["text"]), "")).alias("said"), F.count(F.when(~F.col("is_text"), 1)).alias("elements"))
    said = stored(said.filter(F.char_length("said") > MIN_SELECTION), "selected")
    spans = said.filter("elements > 1").select("page_id", F.lit("selection").alias("source"), "c_seq", "c_end")
    lists = gathered(blocks_from(rows.drop("c_seq", "c_end"), spans)).select("page_id", "blocks")
    stamps = nodes.filter("stamp IS NOT NULL").join(said, "page_id").filter((F.col("seq") <= F.col("c_seq")) & (F.col("end") >= F.col("c_end")))
    anchor = stamps.groupBy("page_id").agg(F.max_by("stamp", "seq").alias("anchor"))
    none = F.lit(None)
    uid = F.concat(F.lit("u"), F.col("anchor").cast("string"))
    one = F.struct(F.lit(0).alias("seq"), F.lit("b0").alias("id"), F.lit("paragraph").alias("kind"), none.cast("int").alias("level"), F.col("said").alias("text"), uid.alias("uid"), none.cast(META).alias("meta"))
    return said.join(lists, "page_id", "left").join(anchor, "page_id", "left").select("page_id", F.coalesce("blocks", F.array(one)).alias("blocks"))
