"""Reading the corpus tables and small helpers for written steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlight.shipping import ship_package
from wardlight.workspace import Workspace

#: Bytes of text that one task may hold; the number of partitions follows from it.
TASK_BYTES = 32 << 20
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 1_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without_ids(df: DataFrame, ids: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``df`` whose ``doc_id`` is not in ``ids``; rows without an id stay.

    All columns stay, whatever their names.  Up to ``BROADCAST_IDS`` ids are broadcast, so
    that texts do not move; more are joined.
    """
    (name,) = free_names(df, "id")
    ids = ws.write(ids.select(F.col("doc_id").cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct(), "ids")
    other = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(other, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they differ from those of all columns, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column; one scan of that column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts_for(size: int, each: int = TASK_BYTES) -> int:
    """Partitions for so many bytes, at least the session's cores."""
    return max(8, -(-size // each))


def number(df: DataFrame, order: list[Column], name: str, ws: Workspace) -> DataFrame:
    """Add ``name`` = 0, 1, 2, … in the given order.

    Equal rows get neighbouring numbers in any order.  The rows are dealt out by range
    (equal keys are split by a random last column) and written with their range; each
    range is numbered by itself and shifted by the sizes of those before it.  Only the
    sizes, one per range, meet in one task and are broadcast.
    """
    from pyspark.sql import Window

    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *(c.alias(n) for c, n in zip(order, names)))
    ranged = ws.write(
        keyed.repartitionByRange(*(F.col(n).asc_nulls_first() for n in names), F.rand(1))
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*(F.col(n).asc_nulls_first() for n in names))
    return (
        ranged.withColumn("_i", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, (F.col("_start") + F.col("_i")).cast("long"))
        .drop("_range", "_i", "_start", *names)
    )
