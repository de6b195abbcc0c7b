"""Hotspots kept up to date by batches equal one run over all reports."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.checks.views import load
from wardlight.operators.clustering import dbscan, dedup_reports
from wardlight.plans.hotspots import hotspots
from wardlight.sources.buckets import BucketStore, bucket_of
from wardlight.streaming.live import LiveHotspots

SCHEMA = "ord long, id string, category string, districtId string, lat double, lng double, severity double"


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def make_rows(seed, n):
    """Dense and thin places, chains that later reports close, copies, rows without coordinates."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        town = int(rng.integers(12))
        lat, lng = 10 + town * 0.08 + rng.normal(0, 0.01), 20 + rng.normal(0, 0.01)
        if rng.random() < 0.2:
            lat, lng = 10 + town * 0.08, 20.0
        if rng.random() < 0.03:
            lat = None
        rows.append((i, str(i), ["roads", "water", None][i % 3], f"d{town % 5:02d}" if i % 11 else None, lat, lng, float(i % 5 + 1)))
    return rows


@pytest.fixture(scope="module")
def districts(spark, sf_dir):
    return load(spark, sf_dir, "districts")


def test_batches_equal_one_run(spark, districts, tmp_path):
    rows = make_rows(3, 400)
    # Late reports with small ord become first ones of chains that are stored already.
    dealt = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    live = LiveHotspots(spark, str(tmp_path / "store"), buckets=16)
    cuts = [0, 150, 250, 320, 390, 400]
    for version, (a, b) in enumerate(zip(cuts, cuts[1:])):
        live.add(spark.createDataFrame(dealt[a:b], SCHEMA), version)
    live.add(spark.createDataFrame(dealt[390:400], SCHEMA), 4)  # a batch that is run again
    whole = spark.createDataFrame(rows, SCHEMA)
    unique = dedup_reports(whole, 50.0)
    located = unique.filter("lat IS NOT NULL")
    assert sorted(r.ord for r in live.unique_reports().collect()) == sorted(r.ord for r in located.collect())
    assert rounded(live.clusters()) == rounded(dbscan(unique, 1500.0, 3).summary())
    for mine, wanted in zip(live.results(districts), hotspots(whole, districts)):
        assert rounded(mine) == rounded(wanted) and mine.columns == wanted.columns
    # An older version can still be read.
    early = dbscan(dedup_reports(spark.createDataFrame(dealt[:250], SCHEMA), 50.0), 1500.0, 3).summary()
    assert rounded(live.clusters(version=1)) == rounded(early)
    live.store.vacuum(keep=1)
    assert live.store.versions() == [4]
    assert rounded(live.clusters()) == rounded(dbscan(unique, 1500.0, 3).summary())


def test_small_batch_reads_little(spark, tmp_path):
    """A batch of one in a hundred, in three of sixty towns, reads under a tenth of the store."""
    towns = spark.range(6000).selectExpr(
        "id AS ord", "'roads' AS category", "'d01' AS districtId", "10 + (id % 60) * 0.5 + (id % 7) * 0.001 AS lat",
        "20 + (id % 11) * 0.001 AS lng", "1D AS severity",
    )
    live = LiveHotspots(spark, str(tmp_path / "store"))
    assert live.add(towns, 0) == {"read": 0, "added": 6000}
    more = towns.filter("ord % 60 < 3 AND ord < 1200").withColumn("ord", F.col("ord") + 10_000)
    done = live.add(more, 1)
    assert done["added"] == 60 and done["read"] == 300
    opened = live.store.snapshot().depth("reports")
    assert max(opened.values()) <= 2


def test_empty_batches(spark, districts, tmp_path):
    live = LiveHotspots(spark, str(tmp_path / "store"), buckets=4)
    live.add(spark.createDataFrame([], SCHEMA), 0)
    ranked, clusters = live.results(districts)
    assert ranked.count() == clusters.count() == 0
    live.add(spark.createDataFrame([(1, "a", "roads", "d01", float("nan"), 1.0, 2.0)], SCHEMA), 1)
    ranked, clusters = live.results(districts)
    assert [(r.districtId, r.complaintCount) for r in ranked.collect()] == [("d01", 1)] and clusters.count() == 0


def test_store_versions(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), {"t": "bucket int, k long, v string"})

    def rows(*pairs):
        return spark.createDataFrame(pairs, "k long, v string").withColumn("bucket", bucket_of("k", buckets=4))

    first = store.change(1)
    first.append("t", rows((1, "a"), (2, "b"), (3, "c")))
    assert store.snapshot().read("t").count() == 0  # not committed yet
    first.commit()
    second = store.change(2)
    second.append("t", rows((4, "d")))
    second.commit()
    bucket = rows((1, "")).first().bucket
    third = store.change(3)
    third.replace("t", rows((1, "z")), [bucket])
    third.commit()
    value = {r.k: r.v for r in store.snapshot().read("t").collect()}
    assert value[1] == "z" and {r.k for r in store.snapshot(2).read("t").collect()} == {1, 2, 3, 4}
    assert {r.k for r in store.snapshot(1).read("t", [bucket]).collect()} == {r.k for r in rows((1, ""), (2, ""), (3, "")).filter(F.col("bucket") == bucket).collect()}
    with pytest.raises(ValueError):
        store.change(4).replace("t", rows((1, "z")), [(bucket + 1) % 4])
