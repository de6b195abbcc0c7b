"""Streaming ingestion, statistics and hotspots.

Every sink writes the folder ``batch=<id>`` of its micro-batch and overwrites it when a
batch is replayed, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wardlight import domain
from wardlight.operators import joins
from wardlight.operators.nearest import NearestIndex
from wardlight.operators.store import overlay_union
from wardlight.plans.ingest import ingest_reports
from wardlight.plans.stats import count_reports, stats_from_counts
from wardlight.streaming.live import LiveHotspots
from wardlight.workspace import Workspace

REFRESH = "30 seconds"


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches written so far, without the batch column."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").select(*[f.name for f in schema])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _start(stream: DataFrame, handle, checkpoint: str, every: str | None, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def stream_ingest(
    submissions: DataFrame, districts: DataFrame, catalog: DataFrame, stored_path: str, rejects_path: str,
    checkpoint: str, every: str | None = None, districts_path: str | None = None,
) -> StreamingQuery:
    """Validate, classify, place and store arriving submissions; rejects go to their own folder.

    Rows of districts that reports bring about go to ``districts_path`` (by default
    beside ``stored_path``), where later batches find them.  The index for the nearest
    district lies beside it and is built anew by batches that bring new districts only;
    ``districts`` must stay the same.

    ``every`` is a processing interval; without it the query takes what is there and ends.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, ws = batch.sparkSession, Workspace(batch.sparkSession)
        made = districts_path or f"{stored_path}-districts"
        given = known = districts.select(*[f.name for f in domain.DISTRICT])
        newest = -1
        if _exists(spark, made):
            # A batch that is run again does not see what it wrote before.
            shape = T.StructType([*given.schema.fields, T.StructField("batch", T.LongType())])
            earlier = spark.read.schema(shape).parquet(made).filter(F.col("batch") < batch_id)
            known = overlay_union(given, earlier.drop("batch"))
            newest = earlier.agg(F.max("batch")).first()[0]
            newest = -1 if newest is None else newest

        def index_of(after: DataFrame) -> NearestIndex:
            # The districts are those as of the last batch that brought any.
            new = joins.has_rows(after.join(known.select("id"), "id", "left_anti"))
            index = NearestIndex(spark, f"{made}-index/batch={batch_id if new else newest}")
            return index if index.exists() and not new else index.build(after, ws)

        stored, rejects, after = ingest_reports(batch, known, catalog, ws, index_of)
        _write_batch(after.join(known.select("id"), "id", "left_anti").select(*given.columns), made, batch_id)
        _write_batch(stored, stored_path, batch_id)
        _write_batch(rejects, rejects_path, batch_id)
        ws.close()

    return _start(submissions, handle, checkpoint, every)


def stream_stats(
    complaints: DataFrame, districts: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep report counts as streaming state and write the statistics after every batch.

    The state has one row per category, language and district in use.
    """

    def handle(counts: DataFrame, batch_id: int) -> None:
        ws = Workspace(counts.sparkSession)
        _write_batch(stats_from_counts(ws.write(counts, "counts"), districts), path, batch_id)
        ws.close()

    return _start(count_reports(complaints), handle, checkpoint, every, "complete")


def stream_hotspots(
    complaints: DataFrame, districts: DataFrame, stored_path: str, ranked_path: str, clusters_path: str,
    checkpoint: str, every: str | None = REFRESH, k: int = 5, **options,
) -> StreamingQuery:
    """Add arriving reports to the store at ``stored_path`` and write the hotspots over all of it.

    A batch reads and computes only the places it touches, see :class:`LiveHotspots`,
    which takes the further options.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, ws = batch.sparkSession, Workspace(batch.sparkSession)
        live = LiveHotspots(spark, stored_path, **options)
        live.add(batch, batch_id, ws)
        ranked, clusters = live.results(districts, k, version=batch_id, workspace=ws)
        _write_batch(ranked, ranked_path, batch_id)
        _write_batch(clusters, clusters_path, batch_id)
        live.store.vacuum()
        ws.close()

    return _start(complaints, handle, checkpoint, every)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of a sink that writes complete results."""
    rows = spark.read.parquet(path)
    newest = rows.selectExpr("max(batch) AS batch").first()["batch"]
    return rows.filter(rows.batch == newest).drop("batch")
