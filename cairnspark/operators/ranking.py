"""Sums and numbers along a global order, without one task that sees all rows.

Rows are dealt into ranges of the order and sorted there; each range adds up its own; what the ranges
before it hold is a sum over a table of one row a range (and group), and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.staging import drop_staged, staged

#: Rows that one range of numbered() has, roughly: what a task sorts at once.
RANGE_ROWS = 1 << 17


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """df, staged in ranges of (by, order), with the sum of each expression over the rows of the same group up to and with this one.

    order must tell the rows of a group apart, else rows that tie are added in any order."""
    whole = [*map(F.col, by), *order]
    part = df.withColumns(sums).repartitionByRange(*whole).withColumn("__part", F.spark_partition_id())
    part = staged(part, "ranges")
    held = part.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*by, "__part", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    own = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = part.withColumns({c: F.sum(c).over(own) for c in sums})
    on = (F.col("__part") == F.col("__r"))
    for b in by:
        on &= F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    offsets = offsets.withColumnRenamed("__part", "__r").withColumnsRenamed({b: f"__by_{b}" for b in by})
    joined = out.join(offsets, on)
    return joined.select(*df.columns, *((F.col(c) + F.col(f"__{c}")).alias(c) for c in sums))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's number in the order, from 1 on.

    The numbers within a range are those that Spark gives its sorted rows as they are written, so no window holds a range, and
    there are as many ranges as the rows need: a task has RANGE_ROWS rows, roughly, however many there are."""
    whole = staged(df, "rows")
    ranges = max(1, -(-whole.count() // RANGE_ROWS))
    part = whole.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    part = staged(part, "ranges").withColumn("__r", F.shiftright("__at", 33))
    drop_staged(whole)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = part.groupBy(F.col("__r").alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = held.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    joined = part.join(F.broadcast(offsets), F.col("__r") == F.col("__part"))
    return joined.select(*df.columns, (F.col("__at") - F.shiftleft("__r", 33) + F.col("__n") + 1).alias(name))
