"""Running sums over a whole table in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.tables import ranges, written


def running(df: DataFrame, order: str, size: Column, out: str = "offset") -> DataFrame:
    """df with the sum of `size` over all rows before, in the order of a unique column.

    The rows are cut into ranges of `order`; each range sums up by itself, and the sum of the ranges before it is added
    from a table with one row per range. No window spans the table. An empty table gives no rows.
    """
    ranged = written(df.withColumn("_size", size.cast("long")).repartitionByRange(ranges(df), order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = ranged.withColumn("_in", inside)
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_size", "_in", "_before")
