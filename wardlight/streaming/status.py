"""The status log as a stream: running maxima per report, everything else append-only.

What a report's current status needs is one row of running maxima, whose size does not
depend on the length of its history.  History entries and rejected events are appended.
Events that name no known report wait, and are tried again with every batch, so that a
report may arrive after its events.  All of it changes in one commit per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.operators import joins, store
from wardlight.sources.buckets import BUCKETS, BucketStore, bucket_of
from wardlight.workspace import Workspace

#: Buckets of more folders than this are merged by the next batch.
MOST_FOLDERS = 8

_EVENT = "complaintId string, seq long, updatedAt timestamp, status string, adminId string, note string"
_AT = "struct<updatedAt: timestamp, seq: long>"
TABLES = {
    "history": f"bucket int, {_EVENT}",
    "current": f"bucket int, complaintId string, status string, at {_AT}, adminNote string, noteAt {_AT}",
    "rejects": f"bucket int, {_EVENT}, reason string",
    "waiting": f"bucket int, {_EVENT}",
}
_COLUMNS = ["complaintId", "seq", "updatedAt", "status", "adminId", "note"]


class StatusStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most_folders: int = MOST_FOLDERS):
        self.spark, self.store, self.buckets, self.most_folders = spark, BucketStore(spark, path, TABLES), buckets, most_folders

    def add(self, events: DataFrame, complaints: DataFrame, version: int, workspace: Workspace | None = None) -> None:
        """Take up a batch of events as ``version``; a version that is taken up again replaces itself."""
        ws = workspace or Workspace(self.spark)
        change = self.store.change(version)
        for table, merged in (("history", _distinct_entries), ("current", _merged)):
            if deep := [b for b, n in change.depth(table).items() if n >= self.most_folders]:
                change.replace(table, self._bucketed(merged(change.read(table, deep))), deep)

        batch = ws.write(events.select(*_COLUMNS), "events")
        bad = batch.withColumn("reason", store.event_fault()).filter("reason IS NOT NULL")
        asked = ws.write(store.clean_status_events(batch).unionByName(change.read("waiting").select(*_COLUMNS)), "asked")
        wanted = ws.write(asked.select(F.col("complaintId").alias("wanted")).distinct(), "wanted")
        names = _asked_for(complaints, wanted).withColumnRenamed("wanted", "complaintId")
        found = ws.write(asked.join(names, "complaintId", "left"), "found")
        known = found.filter("_report IS NOT NULL").withColumn("complaintId", F.col("_report")).select(*_COLUMNS)
        unknown = self._bucketed(found.filter("_report IS NULL").select(*_COLUMNS))

        change.append("rejects", self._bucketed(bad))
        change.append("history", self._bucketed(_distinct_entries(known)))
        change.append("current", self._bucketed(_maxima(known)))
        left = {r.bucket for r in unknown.select("bucket").distinct().collect()}
        change.replace("waiting", unknown, sorted(left | set(change.depth("waiting"))))
        change.commit()

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(F.coalesce("complaintId", F.lit("")), buckets=self.buckets))

    def current(self, version: int | None = None) -> DataFrame:
        """``complaintId, status, adminNote, updatedAt``."""
        rows = _merged(self.store.snapshot(version).read("current"))
        return rows.select("complaintId", "status", "adminNote", F.col("at.updatedAt").alias("updatedAt"))

    def history(self, version: int | None = None) -> DataFrame:
        """Distinct entries, as :func:`wardlight.operators.store.status_history` gives them."""
        return _distinct_entries(self.store.snapshot(version).read("history"))

    def rejected(self, version: int | None = None) -> DataFrame:
        """Rejected events with their ``reason``, those that still wait for their report included."""
        snapshot = self.store.snapshot(version)
        waiting = snapshot.read("waiting").withColumn("reason", F.lit("complaintId"))
        return snapshot.read("rejects").unionByName(waiting).select(*_COLUMNS, "reason")


def _maxima(known: DataFrame) -> DataFrame:
    at = F.struct("updatedAt", "seq")
    noted = F.when(F.col("note").isNotNull(), at)
    return known.groupBy("complaintId").agg(
        F.max_by("status", at).alias("status"), F.max(at).alias("at"), F.max_by("note", noted).alias("adminNote"), F.max(noted).alias("noteAt")
    )


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("complaintId").agg(
        F.max_by("status", "at").alias("status"), F.max("at").alias("at"),
        F.max_by("adminNote", "noteAt").alias("adminNote"), F.max("noteAt").alias("noteAt"),
    )


def _distinct_entries(rows: DataFrame) -> DataFrame:
    return rows.groupBy("complaintId", "updatedAt", "status", "adminId", "note").agg(F.max("seq").alias("seq"))


def _asked_for(complaints: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ones of the names that reports answer to; the reports are not shuffled for a small batch."""
    some = F.broadcast(wanted) if joins.is_small(wanted) else wanted
    return store.first_of_name(store.names_of_reports(complaints).join(some, "wanted", "left_semi"))


def stream_status(
    events: DataFrame, complaints: DataFrame | Callable[[], DataFrame], path: str, checkpoint: str, every: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep a :class:`StatusStore` at ``path`` up to date.

    ``complaints`` may be a function that gives the reports known so far.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ws = Workspace(batch.sparkSession)
        known = complaints() if callable(complaints) else complaints
        kept = StatusStore(batch.sparkSession, path, buckets)
        kept.add(batch, known, batch_id, ws)
        kept.store.vacuum()
        ws.close()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
