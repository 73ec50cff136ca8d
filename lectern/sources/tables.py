"""Inputs as extractions: stored pages, plain texts, texts of PDF pages, selections; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import blocked_url, collapse, file_title, whitespace_words, word_count
from lectern.schema import META

MIN_SELECTION = 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readable(pages: DataFrame) -> DataFrame:
    """Pages whose address may be read."""
    return pages.filter(~blocked_url(F.col("url")))


def paragraphs(texts: Column) -> Column:
    """An array of texts as paragraph blocks."""
    return F.transform(
        texts,
        lambda t, i: F.struct(
            i.cast("int").alias("seq"),
            F.concat(F.lit("b"), i.cast("string")).alias("id"),
            F.lit("paragraph").alias("kind"),
            F.lit(None).cast("int").alias("level"),
            t.alias("text"),
            F.lit(None).cast("string").alias("uid"),
            F.lit(None).cast(META).alias("meta"),
        ),
    )


def _extraction(rows: DataFrame, texts: Column, url: Column, title: Column, lang: Column, strategy: str, words: Column, reason: str) -> DataFrame:
    ok = F.size(texts) > 0
    none = F.lit(None).cast("string")
    return rows.select("page_id", url.alias("url"), ok.alias("ok"), title.alias("title"), none.alias("byline"), none.alias("site_name"), lang.alias("lang"), F.when(ok, strategy).otherwise("none").alias("strategy"), F.when(~ok, reason).alias("reason"), words.cast("int").alias("word_count"), paragraphs(texts).alias("blocks"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Plain texts, each a document of one paragraph a line that has text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: x != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("page_id"), "lang", lines.alias("lines"))
    words = F.aggregate(F.transform("lines", word_count), F.lit(0), lambda a, x: a + x)
    none = F.lit(None).cast("string")
    return _extraction(rows, F.col("lines"), none, none, F.coalesce("lang", F.lit("en")), "text", words, "no text")


def from_pdf(pdfs: DataFrame) -> DataFrame:
    """PDF texts (page_id, url, page_items array of arrays of strings): a paragraph per page that has text."""
    texts = F.filter(F.transform("page_items", lambda items: collapse(F.array_join(items, " "))), lambda t: t != "")
    rows = pdfs.select("page_id", "url", texts.alias("texts"))
    words = F.aggregate(F.transform("texts", whitespace_words), F.lit(0), lambda a, x: a + x)
    return _extraction(rows, F.col("texts"), F.col("url"), file_title(F.col("url")), F.lit("en"), "pdf", words, "no text in the PDF")


def is_pdf(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "[#?].*$", "")).endswith(".pdf")


def from_selection(pages: DataFrame) -> DataFrame:
    """Selections (page_id, url, selection) of more than MIN_SELECTION collapsed characters, as one paragraph."""
    said = collapse(F.coalesce("selection", F.lit("")))
    texts = F.when(F.char_length(said) > MIN_SELECTION, F.array(said)).otherwise(F.array().cast("array<string>"))
    rows = pages.select("page_id", "url", texts.alias("texts"))
    words = F.aggregate(F.transform("texts", word_count), F.lit(0), lambda a, x: a + x)
    none = F.lit(None).cast("string")
    return _extraction(rows, F.col("texts"), F.col("url"), none, F.lit("en"), "selection", words, "nothing is selected")


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """The sink: Parquet, replaced as a whole."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
