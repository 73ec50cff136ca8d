"""A training corpus from raw documents: toxic documents go, lines that many documents share go, near copies go, documents
with benchmark passages go, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir); its rows are stored and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import crc_of_id, persisted, table
from lectern.llm.decontamination import contamination
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.near_dedup import keep_one
from lectern.llm.packing import pack_documents
from lectern.llm.queries import word_bpe
from lectern.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, learning from the labelled rows that are not held out."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), crc_of_id("doc_id") % 5 == 0)
    return scored.filter("predicted = 0").select(docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9; n_chars follows the text."""
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Of each class the least doc_id stays; null, empty and wordless texts and null ids stay."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Rows are judged each by itself; null texts have no words and stay."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Null texts are their end id alone; repeated rows are packed each."""
    return pack_documents(docs, word_bpe(), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express the model of the first stage, nor sampling, alignment and packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
