"""Sharding (operator 12): rendezvous hashing of record keys over weighted shards.

A key draws a waiting time for each shard, exponential with the shard's weight, and goes where it waits least: shards get
rows in proportion to their weights, the key and the weights alone decide, and a shard that is added takes rows from all
others and moves none between them. Draws are 52 bits of an MD5 sum of key and shard, the same in any engine.

Within a shard rows are numbered from 0 by key. Shards are few and may be of any size, so no task holds one: rows are
written in ranges of (shard, key), and a small table says at which slot each range begins.

A null key counts as the key ''. Rows of one key are of one shard, with a slot each; null and empty texts are rows like any
other. Columns named shard or slot are replaced. No rows give empty shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.checksum_sql import CRC_TABLE, crc32_sql
from lectern.llm.common import shared_path
from lectern.llm.numbering import numbered, spread, starts

SHARDS = 16
BITS = 52


def waiting(key: Column, shard: int, weight: float = 1.0) -> Column:
    """How long a key (a string) waits for a shard."""
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, BITS // 4), 16, 10).cast("double")
    return -F.ln((drawn + 0.5) / 2.0**BITS) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; of shards with equal times, the first. A shard of weight 0 gets nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are 0 or more, and one is more")
    text = F.coalesce(key.cast("string"), F.lit(""))
    times = [F.struct(waiting(text, k, w).alias("time"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*times))["shard"]


def write_shards(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, path: str | None = None) -> str:
    """Writes `docs` with their shard under `path`, a new folder of the shared one by default, and returns it: rows/shard=K
    holds a shard's rows, starts the slots at which its parts begin."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    placed = spread(docs.drop("slot").withColumn("shard", rendezvous(F.col(key), weights)), ["shard"], [key])
    placed.write.partitionBy("shard").parquet(f"{path}/rows")
    placed.limit(0).write.parquet(f"{path}/columns")  # where no rows are, no file says what columns they have
    starts(_rows(spark, path), ["shard"]).write.parquet(f"{path}/starts")
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def read_shards(spark: SparkSession, path: str, shards: Sequence[int] | None = None) -> DataFrame:
    """The rows of the given shards, or of all, with shard and slot."""
    rows = _rows(spark, path)
    if shards is not None:
        rows = rows.filter(F.col("shard").isin(*shards))
    # A row for each part and each shard's first part: as many as tasks wrote, however many rows there are.
    return numbered(rows, F.broadcast(spark.read.parquet(f"{path}/starts")), ["shard"], "slot")


def _sql_shard(shards: int) -> str:
    draw = "-ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || k), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"
    return f"(SELECT CAST(arg_min(k, {draw}) AS INTEGER) FROM (SELECT unnest(range({shards})) AS k))"


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, s AS (SELECT doc_id, text, {_sql_shard(SHARDS)} AS shard, {_sql_shard(SHARDS + 1)} AS grown_shard FROM documents)
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM s, crc_table
"""
