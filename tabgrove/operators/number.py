"""Gapless numbers over a total order, without bringing the rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgrove.sources.shared import materialise

# Spark's monotonically_increasing_id: the partition above these bits, the row below.
ROW_BITS = 33


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``, from 0, by ``order``, which should be a total one.

    Rows are dealt into ranges of the order and written once in the shared folder. Each
    range numbers its own rows and adds the rows of the ranges before it: one row for
    each range is all that is brought together.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", ROW_BITS))
    ranges = rows.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    number = F.col("_at") - F.col("_first") + F.col("_before")
    return rows.join(ranges, "_range").withColumn(name, number).drop("_at", "_range", "_first", "_held", "_before")
