"""A cache kept as a table in buckets of keys; a write rewrites the buckets that it touches and no other.

Entries are those of operators.accounting: (key, bytes, created_at, last_used, ...). Rows stored in one call are writes in
the order given; of a key the last counts, against what is there as well. After every EVICT_EVERY writes of a store, counted
over its calls, the entries used longest ago go until the rest fits the budget. Of several such points in one call the last
is looked at, with the writes up to it: earlier ones take nothing that it would leave, unless a call replaces entries by
smaller ones in between. Writes after it stay.

A bucket whose entries have all gone keeps one row without a key, as a folder that is not written is not replaced. Null keys
are not stored. One writer at a time; readers see a bucket before or after a write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.operators.accounting import BUDGET, evicted, running_total
from lectern.plans.storage import stored

#: Fixed value: writes between two looks at the budget.
EVICT_EVERY = 25
BUCKETS = 64


class CacheStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, budget: int = BUDGET, buckets: int = BUCKETS):
        """`schema` has key, bytes, created_at, last_used and what else entries carry."""
        self.spark, self.path, self.budget, self.buckets, self.pending = spark, path, budget, buckets, 0
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _all(self) -> DataFrame:
        """Entries with their bucket, and rows that keep a bucket."""
        whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        try:
            return self.spark.read.schema(whole).parquet(self.path)
        except Exception as e:  # a store that was never written has no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], whole)

    def read(self) -> DataFrame:
        return self._all().filter("key IS NOT NULL").select(*self.columns)

    def _replace(self, entries: DataFrame, touched: DataFrame) -> None:
        """Writes `entries` as the whole of the buckets `touched` (bucket)."""
        keep = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], "bucket")
        # Read before it is overwritten, so stored first.
        rows = stored(entries.join(touched, "bucket", "left_semi").select(*self.columns, "bucket").unionByName(keep), "cache_rows")
        full = rows.filter("key IS NOT NULL").select("bucket").distinct().withColumn("full", F.lit(True))
        rows = rows.join(full, "bucket", "left").filter("key IS NOT NULL OR full IS NULL").drop("full")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def put(self, rows: DataFrame, order: list[str]) -> None:
        """Stores `rows` (entries), written in `order`, whose columns tell them apart."""
        whole = stored(rows.filter("key IS NOT NULL").withColumn("__one", F.lit(1)), "cache_writes")
        placed = stored(running_total(whole, "__one", order, name="__at"), "cache_placed")
        n = placed.count()
        if not n:
            return
        looked = (self.pending + n) // EVICT_EVERY * EVICT_EVERY - self.pending
        self.pending = (self.pending + n) % EVICT_EVERY
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        last = lambda df: df.groupBy("key").agg(F.max_by(F.struct(*self.columns), "__at").alias("e")).select("e.*").withColumn("bucket", bucket)
        old = self._all().filter("key IS NOT NULL")
        written = last(placed)
        if looked <= 0:
            touched = written.select("bucket").distinct()
            self._replace(old.join(written, "key", "left_anti").unionByName(written), touched)
            return
        early, late = last(placed.filter(F.col("__at") <= looked)), last(placed.filter(F.col("__at") > looked))
        then = stored(old.join(early, "key", "left_anti").unionByName(early), "cache_then")
        gone = stored(evicted(then, self.budget).select("key", "bucket"), "cache_gone")
        now = then.join(gone, "key", "left_anti").join(late, "key", "left_anti").unionByName(late)
        touched = written.select("bucket").unionByName(gone.select("bucket")).distinct()
        self._replace(now, touched)

    def touch(self, reads: DataFrame) -> None:
        """Entries read (key, at) are used then; buckets without one stay as they are."""
        last = stored(reads.groupBy("key").agg(F.max("at").alias("__used")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")), "cache_reads")
        used = self._all().filter("key IS NOT NULL").join(last.select("key", "__used"), "key", "left").withColumn("last_used", F.greatest("last_used", "__used")).drop("__used")
        self._replace(used, last.select("bucket").distinct())

    def clear(self) -> None:
        """Nothing is left."""
        if self._all().isEmpty():
            return
        self._replace(self._all().limit(0), stored(self._all().select("bucket").distinct(), "cache_buckets"))
        self.pending = 0


__all__ = ["BUCKETS", "EVICT_EVERY", "CacheStore"]
