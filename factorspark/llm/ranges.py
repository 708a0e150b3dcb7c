"""Dense places in a whole order, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def dense_positions(df: DataFrame, order: list[Column], name: str = "positions", position: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in ``order``; rows that tie in all of it take the places of the tie in any order.

    Rows are range-partitioned, sorted and written once with their range and their place in it; the ranges' counts (one row
    a range) shift them.
    """
    cut = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # One row a partition.
    return cut.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_at")).alias(position))
