"""Nothing is dropped or changed silently: unreadable input, missing places, chosen districts, odd keys."""

from __future__ import annotations

import json

import pytest

from wardlight.checks.views import load
from wardlight.operators import clustering, districts as dist, enrichment, nearest, rate_limit, store, validation
from wardlight.plans import ingest
from wardlight.sources import tables
from wardlight.workspace import Workspace, shared_dir


def _file(tmp_path, text):
    path = tmp_path / "in.json"
    path.write_text(text)
    return str(path)


def test_readers_keep_or_report_every_row(spark, tmp_path):
    row = {"id": "a", "lat": 1.0, "lng": 2.0, "severity": 3.5}
    path = _file(tmp_path, json.dumps([row, {**row, "id": "b", "severity": 2}]))
    assert {r.id: r.severity for r in tables.read_complaints(spark, path).collect()} == {"a": 3.5, "b": 2.0}
    path = _file(tmp_path, json.dumps([row, {"id": "c", "lat": 1.0, "severity": 1}]))
    good, bad = tables.split_complaints(spark, path)
    assert [r.id for r in good.collect()] == ["a"] and [(r.id, r.reason) for r in bad.collect()] == [("c", "lng")]
    with pytest.raises(Exception, match="unreadable input: lng"):
        tables.read_complaints(spark, path).collect()
    path = _file(tmp_path, json.dumps([row, row])[:-20])
    assert [r.reason for r in tables.split_complaints(spark, path)[1].collect()] == ["malformed"]
    with pytest.raises(Exception, match="unreadable input: malformed"):
        tables.read_complaints(spark, path).collect()


PLACES = [(0, 10.0, 20.0), (1, 10.0, 20.0), (2, None, 20.0), (3, 10.0, float("nan")), (4, float("inf"), 1.0), (5, None, None)]


def test_rows_without_places(spark):
    rows = [(o, f"r{o}", "roads", None, a, b) for o, a, b in PLACES]
    df = spark.createDataFrame(rows, "ord long, id string, category string, districtId string, lat double, lng double")
    assert sorted(r.ord for r in clustering.dedup_reports(df, 50.0).collect()) == [0, 2, 3, 4, 5]
    assert {r.memberCount for r in clustering.dbscan(df, 50.0, 2).summary().collect()} == {2}
    districts = spark.createDataFrame([("d", "D", "S", 1.0, 1.0, "C", 1.0, 0)], "id string, name string, state string, lat double, lng double, country string, infraScore double, ord long")
    near = {r.id: r.districtId for r in nearest.nearest_district(df, districts).collect()}
    assert near == {"r0": "d", "r1": "d", "r2": None, "r3": None, "r4": None, "r5": None}
    chosen = df.selectExpr("ord", "id", "IF(ord = 5, 'd', NULL) AS districtId", "lat", "lng")
    placed = {r.id: r.districtId for r in dist.assign_district(chosen, districts).collect()}
    assert placed == {"r0": "d", "r1": "d", "r2": None, "r3": None, "r4": None, "r5": "d"}


def test_chosen_districts_are_kept(spark, sf_dir):
    from pyspark.sql import functions as F

    submissions = load(spark, sf_dir, "submissions").withColumn("photoUrls", F.lit(None).cast("array<string>"))
    stored, _, districts = ingest.ingest_reports(submissions, load(spark, sf_dir, "district_rows"), load(spark, sf_dir, "catalog"))
    chosen = {r.id: r.districtId for r in submissions.filter("districtId LIKE 's%'").collect()}
    kept = {r.id: (r.districtId, r.stateName) for r in stored.collect() if r.id in chosen}
    assert len(kept) > 50 and all(kept[i] == (chosen[i], f"State {chosen[i][1]}") for i in kept)
    assert {r.id for r in districts.collect()} >= {"s0__nation-0", "s1__nation-1"}


def test_status_by_reference_and_rejects(spark):
    reports = spark.createDataFrame([("a", "CP-2024-000001"), ("b", None), ("CP-2024-000002", None)], "id string, referenceId string")
    events = spark.createDataFrame(
        [("CP-2024-000001", 1, "resolved", None), ("a", 2, "reviewing", "n"), ("CP-2024-000002", 3, "resolved", None),
         ("zz", 4, "resolved", None), ("b", 5, "lost", None), ("b", 6, "resolved", "n" * 501)],
        "complaintId string, seq long, status string, note string",
    ).selectExpr("*", "timestamp_seconds(seq) AS updatedAt", "'x' AS adminId")
    history = {(r.complaintId, r.seq) for r in store.status_history(events, reports).collect()}
    assert history == {("a", 1), ("a", 2), ("CP-2024-000002", 3)}
    assert {(r.seq, r.reason) for r in store.rejected_status_events(events, reports).collect()} == {(4, "complaintId"), (5, "status"), (6, "note")}


def test_token_bucket_null_keys_and_rates(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(5)] + [("k", i, i) for i in range(5)], "k string, s long, n long").selectExpr("k", "timestamp_seconds(s) AS t", "n")
    flags = rate_limit.token_bucket(df, "k", "t", "n", 2.0, 0.5).collect()
    assert sorted(r.allowed for r in flags if r.k is None) == sorted(r.allowed for r in flags if r.k == "k") and len(flags) == 10
    assert rate_limit.units(1.0, 1e-7)[1] > 0
    assert rate_limit.flag_run([10, 5, 10], 0, 10, rate_limit.units(1.0, 100.0)) == ([False] * 3, 0)
    with pytest.raises(ValueError):
        rate_limit.units(1e30, 0.123456789)


def test_rules(spark):
    df = spark.sql("SELECT * FROM VALUES ('12.5f'), ('12.5d'), ('1e1'), (' 12.5 '), ('.5'), ('NaN'), ('0x1p3') AS t(v)")
    got = {r.v: r.n for r in df.select("v", validation._coordinate(df.v, 90.0).alias("n")).collect()}
    assert got == {"12.5f": None, "12.5d": None, "1e1": 10.0, " 12.5 ": 12.5, ".5": 0.5, "NaN": None, "0x1p3": None}
    with pytest.raises(ValueError):
        store.page_reports(df, 500)
    hot = spark.sql("SELECT 'd' AS districtId, 'roads' AS topCategory, 3L AS complaintCount, 2.0D AS avgSeverity, 6.0D AS priorityScore")
    answers = spark.sql("""SELECT 0 AS ord, '{"recommendations": [{"districtId": "d", "recommendation": "Fix it"}, {"districtId": "d", "recommendation": 5}]}' AS json""")
    assert enrichment.merge_recommendations(hot, answers).first().recommendation == "Fix it"


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
