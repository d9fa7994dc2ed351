"""Sums and minima along a total order without bringing the whole order into one task.

The order is an integer. It is cut into ranges of `width`; what a range contributes is aggregated first (one row for
each range goes through a single task), and rows are ranked within their range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_536


def running_sum(df: DataFrame, order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the sum of value over all rows up to and including each row."""
    cut = df.withColumn("_v", value).withColumn("_range", F.floor(F.col(order) / width))
    sums = cut.groupBy("_range").agg(F.sum("_v").alias("_s"))
    before = sums.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_range").orderBy(order))
    return cut.join(before, "_range").withColumn(name, F.col("_before") + inside).drop("_v", "_range", "_before")


def later_minimum(df: DataFrame, order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the smallest value among the rows strictly after each row (null after the last)."""
    cut = df.withColumn("_v", value).withColumn("_range", F.floor(F.col(order) / width))
    least = cut.groupBy("_range").agg(F.min("_v").alias("_m"))
    # from the end on, so that each frame grows by one row: one that shrinks is evaluated anew for each row
    seen = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    later = least.select("_range", F.min("_m").over(seen(Window.orderBy(F.col("_range").desc()))).alias("_later"))
    inside = F.min("_v").over(seen(Window.partitionBy("_range").orderBy(F.col(order).desc())))
    return cut.join(later, "_range").withColumn(name, F.least(inside, "_later")).drop("_v", "_range", "_later")
