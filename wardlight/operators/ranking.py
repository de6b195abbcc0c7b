"""Consecutive numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardlight.workspace import Workspace


def number_rows(df: DataFrame, order_by: str, name: str, ws: Workspace) -> DataFrame:
    """Add ``name`` = 0, 1, 2, … in the order of the unique column ``order_by``.

    Rows are range-partitioned and written with their partition number; each range is
    numbered by itself and shifted by the sizes of the ranges before it.
    """
    ranged = ws.write(
        df.repartitionByRange(F.col(order_by)).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(order_by)
    return (
        ranged.withColumn("_i", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_start") + F.col("_i")).cast("long"))
        .drop("_range", "_i", "_start")
    )
