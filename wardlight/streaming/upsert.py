"""Upserts as a stream: a bucketed base with deltas, of which the last write per id counts.

A batch appends its own last writes as one delta per bucket.  Readers merge a bucket's
deltas by id; a bucket that has collected many is merged into one by the next batch, so
neither a batch nor a reader pays for the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.operators.store import upsert_complaints
from wardlight.sources.buckets import BUCKETS, BucketStore, bucket_of

#: Buckets of more deltas than this are merged by the next batch.
MOST_FOLDERS = 8


class UpsertStore:
    """Rows of ``schema`` (with a string ``id``), ordered by the column ``version_column``, then by arrival."""

    def __init__(self, spark: SparkSession, path: str, schema: str, version_column: str, buckets: int = BUCKETS, most_folders: int = MOST_FOLDERS):
        self.store = BucketStore(spark, path, {"rows": f"bucket int, _arrival long, {schema}"})
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self.version_column, self.buckets, self.most_folders = version_column, buckets, most_folders

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take up a batch; one that is taken up again replaces itself."""
        change = self.store.change(batch)
        if deep := [b for b, n in change.depth("rows").items() if n >= self.most_folders]:
            change.replace("rows", self._last(change.read("rows", deep)), deep)
        bucket = bucket_of(F.coalesce("id", F.lit("")), buckets=self.buckets)
        new = upsert_complaints(rows.select(*self.columns), self.version_column)
        change.append("rows", new.withColumns({"_arrival": F.lit(batch).cast("long"), "bucket": bucket}))
        change.commit()

    def _last(self, rows: DataFrame) -> DataFrame:
        ordered = rows.withColumn("_order", F.struct(self.version_column, "_arrival"))
        return upsert_complaints(ordered, "_order").drop("_order")

    def read(self, batch: int | None = None) -> DataFrame:
        """The last write per id, as of the newest batch or of an earlier one."""
        return self._last(self.store.snapshot(batch).read("rows")).select(*self.columns)

    def get(self, ids: list[str], batch: int | None = None) -> DataFrame:
        """The rows of some ids; only their buckets are opened."""
        spark = self.store.spark
        wanted = spark.createDataFrame([(i,) for i in ids], "id string")
        buckets = [r.b for r in wanted.select(bucket_of("id", buckets=self.buckets).alias("b")).distinct().collect()]
        rows = self.store.snapshot(batch).read("rows", buckets).filter(F.col("id").isin(ids))
        return self._last(rows).select(*self.columns)


def stream_upsert(
    rows: DataFrame, path: str, schema: str, version_column: str, checkpoint: str, every: str | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep an :class:`UpsertStore` at ``path`` up to date."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = UpsertStore(batch.sparkSession, path, schema, version_column, buckets)
        kept.add(batch, batch_id)
        kept.store.vacuum()

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
