"""What the operators share: shared storage, tokenizer access and small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.storage import shared_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persisted(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder: lineage ends there and losing an executor costs nothing. Repeated
    rows stay, and a table without rows keeps its columns."""
    return stored(df, name)


def crc_of_id(doc_id: str | Column) -> Column:
    """crc32 of an id's decimal text, as the train/held-out splits use it. A null id counts as the text ''."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


__all__ = ["crc_of_id", "persisted", "shared_path", "table", "text_bytes"]
