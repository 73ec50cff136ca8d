"""Row types: pages, blocks in reading order, utterances, statistics."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of blocks.
KINDS = ("heading", "paragraph", "list-item", "quote", "figure", "code", "table", "math")

META = T.StructType(
    [
        T.StructField("lines", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("cols", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("uid", T.StringType()),
        T.StructField("meta", META),
    ]
)
EXTRACTION = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("title", T.StringType()),
        T.StructField("byline", T.StringType()),
        T.StructField("site_name", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
    ]
)
