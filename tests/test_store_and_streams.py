"""Sources, sinks, paging, rate limits and streams."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlight import domain
from wardlight.checks.views import VIEWS, load
from wardlight.functions import display
from wardlight.functions import text as tx
from wardlight.operators import store, validation
from wardlight.operators.districts import seed_quality
from wardlight.operators.pages import PageStore
from wardlight.operators.rate_limit import flag_run, token_bucket, units
from wardlight.plans.classify import classify_reports
from wardlight.plans.ingest import ingest_reports
from wardlight.plans.stats import stats
from wardlight.sources import seed, sinks, tables
from wardlight.streaming import reports as streams, stateful, status, upsert
from wardlight.streaming.classes import ClassStore


def test_read_json_with_defaults(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([
        {"id": "a", "category": "roads", "districtId": "d", "lat": 1.5, "lng": 2, "severity": 3, "tags": ["x"], "timestamp": "2025-01-02T03:04:05.000Z"},
        {"lat": 1, "lng": 2, "severity": 1}, {"id": "no-severity", "lat": 1, "lng": 2},
    ]))
    good, bad = tables.split_complaints(spark, str(path))
    rows = good.orderBy("id").collect()
    assert [(r.id, r.reason) for r in bad.collect()] == [("no-severity", "severity")]
    assert [(r.id, r.category, r.districtId) for r in rows] == [("", "", ""), ("a", "roads", "d")]
    assert rows[1].timestamp == datetime(2025, 1, 2, 3, 4, 5) and rows[1].tags == ["x"]
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{"id": "d", "lat": 1, "lng": 2}, {"id": "e", "lat": 1, "lng": 2, "infraScore": 4}]))
    assert {r.id: r.infraScore for r in tables.read_districts(spark, str(path)).collect()} == {"d": 1.0, "e": 4.0}


def test_write_batched(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_batched(spark.range(1200).coalesce(1), out)
    sizes = spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in sizes) == [200, 500, 500]


def test_seed_and_benchmark(spark):
    districts = seed.seed_districts(spark)
    numbered = spark.createDataFrame([(i, r.id, r.lat, r.lng) for i, r in enumerate(districts.collect())], "ord int, id string, lat double, lng double")
    reports = seed.gen_seed(numbered)
    assert all(seed_quality(districts, reports).first())
    first = reports.filter("id = 'demo-rajasthan__jaipur-1'").first()
    assert first.rawText.startswith("Potholes") and first.timestamp == datetime(2025, 1, 1)
    bench, dims = seed.gen_benchmark(spark, 6000)
    assert bench.count() == 6000 and dims.count() == 100
    assert bench.groupBy("category").count().filter("count = 1000").count() == 6
    assert bench.filter("lat BETWEEN -55 AND 70 AND lng BETWEEN -170 AND 170").count() == 6000


def test_guard_rejects_bad_rows(spark):
    bad = spark.createDataFrame([("d", 1.0, "noise", 1, 1.0)], "districtId string, priorityScore double, topCategory string, complaintCount int, avgSeverity double")
    with pytest.raises(Exception, match="invalid ranked district"):
        validation.conform_hotspots(bad).collect()


def test_pages_chain_over_all_reports(spark, sf_dir):
    rows = load(spark, sf_dir, "complaints").select("id", "userId", "timestamp").filter("ord < 130")
    seen, cursor = [], None
    while True:
        page = store.page_reports(rows, 50, cursor).orderBy("position").collect()
        seen += [r.id for r in page]
        cursor = page[0].nextCursor
        if cursor is None:
            break
    assert seen == [r.id for r in rows.orderBy(F.desc("timestamp"), "id").collect()]
    other = rows.filter("userId IS NOT NULL").first()
    token = spark.range(1).select(display.encode_cursor(F.lit(other.id)).alias("c")).first().c
    for bad, user in ((token, "someone"), ("!!", None), ("bm9uZQ", None)):
        with pytest.raises(store.UnknownCursor):
            store.page_reports(rows, 5, bad, user)


def test_pages_of_a_clustered_store(spark, sf_dir, tmp_path):
    """Pages equal those over all rows; a store of ten times as many files opens as few of them."""
    rows = load(spark, sf_dir, "complaints").select("id", "userId", "timestamp")
    opened = []
    for name, per_file in (("few", 400), ("many", 40)):
        kept = PageStore(spark, str(tmp_path / name), buckets=4).build(rows, per_file)
        cursor, mine = None, []
        for _ in range(3):
            page = kept.page(30, cursor).orderBy("position").collect()
            mine += [tuple(r) for r in page]
            cursor = page[0].nextCursor
            opened.append(len(kept.files_of(31, kept._place(cursor))))
        cursor, whole = None, []
        for _ in range(3):
            page = store.page_reports(rows, 30, cursor).orderBy("position").collect()
            whole += [tuple(r) for r in page]
            cursor = page[0].nextCursor
        assert mine == whole
    assert max(opened) <= 4
    last = rows.orderBy("timestamp", F.desc("id")).first().id
    token = spark.range(1).select(display.encode_cursor(F.lit(last)).alias("c")).first().c
    assert kept.page(5, token).count() == 0
    for bad in ("!!", "bm9uZQ"):
        with pytest.raises(store.UnknownCursor):
            kept.page(5, bad)


def test_texts_of_a_stream_are_classified_once(spark, sf_dir, tmp_path):
    """Three batches, one of them run again: each fingerprint is classified in the first batch that has it."""
    texts = load(spark, sf_dir, "texts").filter("id < 120").withColumn("text", tx.collapse_spaces(F.lower(F.substring("text", 1, 60))))
    kept, got, counts = ClassStore(spark, str(tmp_path / "s"), buckets=4, blocks=8), {}, []
    parts = [texts.filter("id < 60"), texts.filter("id >= 30 AND id < 90"), texts]
    for version, part in enumerate(parts):
        for _ in range(2 if version == 1 else 1):
            rows, new = kept.add(part, version)
            found = {r.id: r.classification for r in rows.collect()}
        assert len(found) == part.count()
        got |= found
        counts.append(new)
    wanted = {r.id: r.classification for r in classify_reports(texts).collect()}
    assert got == wanted
    prints = [{r[0] for r in p.select(tx.text_fingerprint(F.col("text"), F.col("language"), F.nullif("userCategory", F.lit("")))).collect()} for p in parts]
    assert counts == [len(prints[0]), len(prints[1] - prints[0]), len(prints[2] - prints[1] - prints[0])] and counts[1] > 0


def test_signup_falls_back_to_seed(spark):
    from wardlight.operators.districts import signup_districts

    none = seed.seed_districts(spark).withColumn("country", F.lit("Elsewhere"))
    assert signup_districts(none, seed.seed_districts(spark)).count() == 26


def make_events(n, keys, seed_no, gap_ms):
    rng = random.Random(seed_no)
    now, rows = datetime(2025, 1, 1), []
    for i in range(n):
        now += timedelta(milliseconds=rng.choice([0, 1, gap_ms, gap_ms * 4, 60_000 if rng.random() < 0.02 else gap_ms]))
        rows.append((rng.choices(range(keys), [n] + [1] * (keys - 1))[0], now, i))
    return rows


@pytest.mark.parametrize("gap_ms", [100, 900])
def test_token_bucket_splits_a_hot_key_exactly(spark, gap_ms):
    rows = make_events(1500, 5, gap_ms, gap_ms)
    events = spark.createDataFrame(rows, "k int, ts timestamp, i int")
    scale, want = units(20.0, 0.5), {}
    for key in range(5):
        mine = [(int((t - datetime(1970, 1, 1)).total_seconds() * 1000) * 1000, i) for k, t, i in rows if k == key]
        if mine:
            flags, _ = flag_run([t for t, _ in mine], scale[2], mine[0][0], scale)
            want |= {i: f for (_, i), f in zip(mine, flags)}
    whole = {r.i: r.allowed for r in token_bucket(events, "k", "ts", "i").collect()}
    parts = {r.i: r.allowed for r in token_bucket(events, "k", "ts", "i", chunk_rows=100).collect()}
    assert whole == want == parts and not all(want.values()) and any(want.values())


def split_events(spark, sf_dir, folder, parts=4):
    events = load(spark, sf_dir, "events")
    size = -(-events.count() // parts)
    for i in range(parts):
        part = events.filter((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size))
        part.coalesce(1).write.mode("append").parquet(folder)
    return events.schema


def stream_of(spark, folder, schema, view=None):
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return spark.sql(VIEWS[view], events=events) if view else events


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    schema = split_events(spark, sf_dir, folder)
    districts, catalog = (load(spark, sf_dir, t) for t in ("districts", "catalog"))

    submissions = stream_of(spark, folder, schema, "submissions").withColumn("photoUrls", F.lit(None).cast("array<string>"))
    paths = [str(tmp_path / p) for p in ("stored", "rejects", "log1")]
    query = streams.stream_ingest(submissions, districts, catalog, *paths)
    query.awaitTermination()
    got = streams.read_batches(spark, paths[0], domain.COMPLAINT)
    whole = load(spark, sf_dir, "submissions").withColumn("photoUrls", F.lit(None).cast("array<string>"))
    stored, rejects, _ = ingest_reports(whole, districts, catalog)
    assert got.exceptAll(stored).count() == 0 and stored.exceptAll(got).count() == 0
    assert spark.read.parquet(paths[1]).select("batch").distinct().count() > 1
    assert spark.read.parquet(paths[1]).count() == rejects.count()
    # The nearest-district index is built by batches that bring new districts, not by all four.
    made = spark.read.parquet(f"{paths[0]}-districts").select("batch").distinct().count()
    built = [p.name for p in (tmp_path / "stored-districts-index").iterdir() if p.is_dir()]
    assert len(built) <= made + 1 and len(built) < 4

    complaints = load(spark, sf_dir, "complaints")
    streams.stream_stats(
        stream_of(spark, folder, schema, "complaints"), districts, str(tmp_path / "stats"), str(tmp_path / "log2")
    ).awaitTermination()
    latest = streams.latest_batch(spark, str(tmp_path / "stats")).select("dimension", "key", "n")
    want = stats(complaints, districts)
    assert latest.exceptAll(want).count() == 0 and want.exceptAll(latest).count() == 0


def test_stateful_streams_equal_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    schema = split_events(spark, sf_dir, folder)
    events = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    flags = stateful.stream_token_bucket(
        stream_of(spark, folder, schema).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")),
        "user_id", "ts", "event_id", 3.0, 1 / 8192,
    )
    flags.writeStream.format("parquet").option("path", str(tmp_path / "flags")).option(
        "checkpointLocation", str(tmp_path / "log1")
    ).trigger(availableNow=True).start().awaitTermination()
    got = {(r.event_id, r.allowed) for r in spark.read.parquet(str(tmp_path / "flags")).collect()}
    want = token_bucket(events, "user_id", "ts", "event_id", 3.0, 1 / 8192).collect()
    assert got == {(r.event_id, r.allowed) for r in want} and len(got) == len(want)


def test_status_stream_equals_batch(spark, sf_dir, tmp_path):
    """Over several batches, with reports that arrive after their events."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "status")
    schema = split_events(spark, sf_dir, folder, 5)
    complaints, arrived = load(spark, sf_dir, "complaints"), []

    def known():
        arrived.append(0)
        return complaints.filter(F.col("ord") % 5 < len(arrived))

    status.stream_status(stream_of(spark, folder, schema, "status_events"), known, path, str(tmp_path / "log"), buckets=4).awaitTermination()
    assert len(arrived) == 5
    kept, events = status.StatusStore(spark, path, 4), load(spark, sf_dir, "status_events")
    # An empty batch, and one that is run again, change nothing.
    kept.add(events.limit(0), complaints, 5)
    kept.add(events.limit(0), complaints, 5)
    history = store.status_history(events, complaints)
    columns = ["complaintId", "updatedAt", "status", "adminId", "note", "seq"]
    assert sorted(kept.history().select(*columns).collect(), key=repr) == sorted(history.select(*columns).collect(), key=repr)
    want = store.current_status(history).drop("entries")
    assert sorted(kept.current().select(*want.columns).collect()) == sorted(want.collect())
    rejected = store.rejected_status_events(events, complaints).select("complaintId", "seq", "reason").collect()
    assert sorted(kept.rejected().select("complaintId", "seq", "reason").collect()) == sorted(rejected)
    assert {r.reason for r in rejected} == {"status", "note", "complaintId"}
    # Running maxima: at most one row per report and folder, and one again after a merge.
    rows = kept.store.snapshot().read("current")
    deepest = max(kept.store.snapshot().depth("current").values())
    assert rows.groupBy("complaintId").count().agg(F.max("count")).first()[0] <= deepest
    merging = status.StatusStore(spark, path, 4, most_folders=1)
    merging.add(events.limit(0), complaints, 6)
    assert merging.store.snapshot().read("current").count() == want.count()
    assert sorted(merging.current().select(*want.columns).collect()) == sorted(want.collect())


def test_idle_buckets_are_dropped(spark, tmp_path):
    """Keys that stall for longer than a refill leave the state; the flags stay those of one batch."""
    start = datetime(2025, 1, 1)
    rows, folder = [], str(tmp_path / "in")
    for part in range(6):
        new = [(1000 * part + k, start + timedelta(hours=3 * part, seconds=j), 10_000 * part + 10 * k + j) for k in range(50) for j in range(5)]
        # A key that stays, drained each time, and one that comes back after a stall.
        new += [(-1, start + timedelta(hours=3 * part, seconds=j), 10_000 * part + 5000 + j) for j in range(8)]
        new += [(-2, start + timedelta(hours=3 * part, seconds=j), 10_000 * part + 6000 + j) for j in range(6)] if part in (0, 5) else []
        rows += new
        spark.createDataFrame(new, "k long, ts timestamp, i long").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("k long, ts timestamp, i long").option("maxFilesPerTrigger", 1).parquet(folder)
    flags = stateful.stream_token_bucket(stream, "k", "ts", "i", 3.0, 1 / 1024, "10 minutes")
    query = flags.writeStream.format("parquet").option("path", str(tmp_path / "flags")).option(
        "checkpointLocation", str(tmp_path / "log")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.i: r.allowed for r in spark.read.parquet(str(tmp_path / "flags")).collect()}
    events = spark.createDataFrame(rows, "k long, ts timestamp, i long")
    assert got == {r.i: r.allowed for r in token_bucket(events, "k", "ts", "i", 3.0, 1 / 1024).collect()} and not all(got.values())
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # 302 keys came by; the state never holds more than those of two parts.
    assert max(held) <= 104 and held[-1] <= 60


def test_upserts_replay_and_merge(spark, tmp_path):
    """The last write wins over batches, replays and merges; older batches can still be read."""
    schema, rng, written = "id string, v long, x string", random.Random(4), []
    kept = upsert.UpsertStore(spark, str(tmp_path / "rows"), schema, "v", buckets=4, most_folders=2)
    for batch in range(6):
        rows = [(f"k{rng.randrange(40)}", rng.randrange(60), f"{batch}-{i}") for i in range(30)]
        rows = list({(r[0], r[1]): r for r in rows}.values())  # one write per id and version
        for _ in range(2 if batch in (2, 5) else 1):
            kept.add(spark.createDataFrame(rows, schema), batch)
        written.append(rows)

    def last(batches):
        best = {}
        for rows in batches:
            for r in rows:
                if r[0] not in best or r[1] >= best[r[0]][1]:
                    best[r[0]] = r
        return sorted(best.values())

    assert sorted(map(tuple, kept.read().collect())) == last(written)
    assert sorted(map(tuple, kept.read(3).collect())) == last(written[:4])
    assert max(kept.store.snapshot().depth("rows").values()) <= 3
    some = [r for r in last(written) if r[0] in ("k1", "k2", "k3")]
    assert sorted(map(tuple, kept.get(["k1", "k2", "k3", "none"]).collect())) == some
