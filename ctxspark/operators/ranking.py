"""Ranks and running totals over a whole table, with no task that has all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def ranked(df: DataFrame, order: list, amount: Column | None = None) -> DataFrame:
    """df with rank (from 1) by the order, and with an amount `used`, its total up to each row.

    Rows are dealt out by ranges of the order and sorted within them; a row's rank is its place in its range and the rows of the
    ranges before. The order should have few ties: rows that are equal in it are in one range.
    """
    sized = df.withColumn("_amount", F.lit(0) if amount is None else amount)
    runs = stored(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    at = runs.withColumn("_range", F.shiftrightunsigned("_at", 33))
    # A row for each range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_sum"), F.min("_at").alias("_first"))
    starts = sums.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_had"))
    out = at.join(F.broadcast(starts), "_range").withColumn("rank", (F.col("_start") + F.col("_at") - F.col("_first") + 1).cast("long"))
    if amount is not None:
        within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("used", F.col("_had") + F.sum("_amount").over(within))
    return out.drop("_amount", "_at", "_range", "_first", "_start", "_had")
