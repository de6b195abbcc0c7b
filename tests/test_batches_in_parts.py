"""Micro-batches of several files, and the names of reports read in one pass."""

from pyspark.sql import functions as F

from wardlight.checks import registry
from wardlight.operators import store


def test_a_batch_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "_FILE_ROWS", 50)
    seen = []
    spark.range(1200).selectExpr(
        "id AS event_id", "TIMESTAMP'2024-01-01' AS ts", "id % 7 AS user_id", "'x' AS event_type", "1.0D AS value", "'{}' AS props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    rows = registry._stream(spark, str(tmp_path), batches=3)
    rows.writeStream.foreachBatch(
        lambda batch, _: seen.append(batch.select("event_id", F.input_file_name().alias("file")).collect())
    ).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/log").start().awaitTermination()
    assert [sorted(r.event_id for r in batch) for batch in seen] == [list(range(i, i + 400)) for i in (0, 400, 800)]
    assert all(len({r.file for r in batch}) > 1 for batch in seen)


def test_names_of_reports_in_one_pass(spark):
    rows = [("b", "CP-2024-000001"), ("a", "CP-2024-000001"), ("CP-2024-000002", None), ("c", "CP-2024-000002"), ("d", "no pattern"), (None, None)]
    complaints = spark.createDataFrame(rows, "id string, referenceId string")
    names = store.report_names(complaints)
    got = {r.wanted: r._report for r in names.collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "d": "d", None: None, "CP-2024-000001": "a", "CP-2024-000002": "CP-2024-000002"}
    plan = names._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
