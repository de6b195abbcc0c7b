"""Pages of reports from a store that is clustered in page order.

Files hold consecutive reports, newest first and then by id, and a small table knows the
first and last report of each file.  A page opens the few files that can hold it, however
many there are; a cursor, which names a report by its id, is looked up in one bucket of
an index by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlight.functions import display
from wardlight.operators.store import UnknownCursor, _page
from wardlight.sources.buckets import BUCKETS, bucket_of

ROWS_PER_FILE = 100_000


def _key(time: str = "timestamp", id_: str = "id") -> Column:
    """Ascending in page order."""
    return F.struct((-F.unix_micros(time)).alias("t"), F.col(id_).alias("i"))


class PageStore:
    """Reports with ``id`` and ``timestamp``, neither of them null."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, reports: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> PageStore:
        files = max(1, -(-reports.count() // rows_per_file))
        order = [F.desc("timestamp"), F.asc("id")]
        reports.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/rows")
        stored = self.spark.read.parquet(f"{self.path}/rows").select("id", "timestamp", F.col("_metadata.file_path").alias("file"))
        stored.groupBy("file").agg(F.min(_key()).alias("first"), F.max(_key()).alias("last"), F.count("*").alias("n")).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/files")
        stored.select("id", "timestamp", bucket_of("id", buckets=self.buckets).alias("bucket")).repartition("bucket").write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(f"{self.path}/ids")
        return self

    def files_of(self, limit: int, after: tuple[int, str] | None = None) -> list[str]:
        """The files that can hold the ``limit`` reports after a place in page order."""
        known = self.spark.read.parquet(f"{self.path}/files")
        if after is not None:
            place = F.struct(F.lit(after[0]).cast("long").alias("t"), F.lit(after[1]).alias("i"))
            known = known.filter(F.col("last") > place).withColumn("whole", F.col("first") > place)
        else:
            known = known.withColumn("whole", F.lit(True))
        names, held = [], 0
        # No file is empty, so these are enough.
        for r in known.orderBy("first").limit(limit + 1).collect():
            names.append(r["file"])
            held += r["n"] if r["whole"] else 0
            if held >= limit:
                break
        return names

    def page(self, limit: int = 20, cursor: str | None = None) -> DataFrame:
        """As :func:`wardlight.operators.store.page_reports` without a user."""
        size, after = int(limit), None
        if not 1 <= size <= 100:
            raise ValueError("limit must be from 1 to 100")
        if cursor is not None:
            after = self._place(cursor)
        rows = self.spark.read.parquet(f"{self.path}/rows")
        files = self.files_of(size + 1, after)
        if files:
            schema = rows.schema
            rows = self.spark.read.schema(schema).parquet(*files)
        if after is not None:
            rows = rows.filter(_key() > F.struct(F.lit(after[0]).cast("long").alias("t"), F.lit(after[1]).alias("i")))
        return _page(rows, size)

    def _place(self, cursor: str) -> tuple[int, str]:
        one = self.spark.range(1).select(display.decode_cursor(F.lit(cursor)).alias("id"))
        asked = one.withColumn("bucket", bucket_of("id", buckets=self.buckets)).first()
        at = None
        if asked["id"]:
            ids = self.spark.read.parquet(f"{self.path}/ids").filter(F.col("bucket") == asked["bucket"])
            at = ids.filter(F.col("id") == asked["id"]).select(_key().alias("k")).first()
        if at is None:
            raise UnknownCursor("cursor report was not found")
        return at["k"]["t"], at["k"]["i"]
