"""Pairs of cells that are joined already are not split."""

from __future__ import annotations

from wardlight.operators import cells
from wardlight.operators.clustering import dbscan


def test_dense_places_need_no_quarter_cells(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("split")

    monkeypatch.setattr(cells, "_split_until_decided", fail)
    # A grid of points 200 m apart over 6 km: every cell holds many, and neighbours are near.
    df = spark.range(900).selectExpr("id AS ord", "10 + (id % 30) * 0.0018D AS lat", "20 + floor(id / 30) * 0.0018D AS lng")
    found = dbscan(df, 1500.0, 3).summary().collect()
    assert [(r.clusterId, r.memberCount) for r in found] == [(0, 900)]
