"""Gapless numbers within groups, in order, without a task for each group.

Rows are spread by ranges of (group, order), so that a group of any size lies in as many parts as it needs, and stored with
their place in their part. The parts' counts, a row for each part and group, say at which number a part begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import persisted

#: Bits below a part's number in what monotonically_increasing_id() returns.
PLACE_BITS = 33


def spread(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` in ranges of (group, order) with __at, their place; nulls come first. Rows that are equal in these are told
    apart by where they stood, so that many equal rows can be parted too."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*group, *order, "__tie"]
    return tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id())


def starts(placed: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, __part, __first, __before, __size): of each part the first place, the group's rows in earlier parts, and the
    group's rows in all."""
    part = F.shiftright("__at", PLACE_BITS).alias("__part")
    parts = placed.groupBy(*group, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    of = Window.partitionBy(*group)
    earlier = of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before, size = F.coalesce(F.sum("__n").over(earlier), F.lit(0)), F.sum("__n").over(of)
    return parts.withColumns({"__before": before, "__size": size}).drop("__n")


def numbered(placed: DataFrame, begun: DataFrame, group: Sequence[str], name: str, size: str | None = None) -> DataFrame:
    """`placed` with `name`, from 0 in each group, and with the group's size if that is named. Groups aren't null."""
    joined = placed.withColumn("__part", F.shiftright("__at", PLACE_BITS)).join(begun, [*group, "__part"])
    out = joined.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before"))
    if size:
        out = out.withColumn(size, F.col("__size"))
    return out.drop("__at", "__part", "__first", "__before", "__size")


def number(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, size: str | None = None) -> DataFrame:
    """`rows`, stored, with their number within their group."""
    placed = persisted(spread(rows, group, order), "placed")
    return numbered(placed, starts(placed, group), group, name, size)
