"""Tables that a plan stores between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured it is the warehouse's, and in a local session,
    where there is one machine only, a temporary one."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        root = tempfile.mkdtemp(prefix="lectern-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        if not alone and (root.startswith("file:") or "://" not in root and ":/" not in root and not _shared_default(spark)):
            raise ValueError(f"set {CHECKPOINT_DIR}: {root} is a folder of one machine, which executors don't share")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def _shared_default(spark: SparkSession) -> bool:
    """Whether a path without a scheme is on a file system that machines share."""
    return not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; callers own what they write there."""
    return f"{shared_root(spark)}/lectern/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once: later steps read the same rows however often they are computed again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many parts as tasks can run, if it has fewer: a table of one row group is one part, and what is computed
    for each of its rows would be one task's. Larger tables stay as they are read, without a shuffle."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= most else df.repartition(most)
