"""Clusters, duplicates, components and nearest search against fixed values and brute force."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.functions import geo
from wardlight.operators import nearest as near_mod
from wardlight.operators.aggregates import aggregate_by_district, top_districts
from wardlight.operators.clustering import dbscan, dedup_reports, radius_join
from wardlight.operators.components import connected_components
from wardlight.plans.hotspots import hotspots

# Example reports and districts with known results.
REPORTS = [
    (0, "c1", "roads", "north", 28.61390, 77.20900, 5),
    (1, "c2", "roads", "north", 28.61400, 77.20910, 3),
    (2, "c3", "water", "north", 28.61390, 77.20900, 4),
    (3, "c4", "water", "south", 12.97160, 77.59460, 2),
]
DISTRICTS = [
    (0, "north", "North", "X", "N", 28.6139, 77.2090, 2.0),
    (1, "south", "South", "X", "S", 12.9716, 77.5946, 8.0),
    (2, "east", "East", "X", "E", 22.5726, 88.3639, 4.0),
]
SHAPE = "ord long, id string, category string, districtId string, lat double, lng double, severity int"
DISTRICT_SHAPE = "ord long, id string, name string, country string, state string, lat double, lng double, infraScore double"


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(REPORTS, SHAPE)


@pytest.fixture(scope="module")
def districts(spark):
    return spark.createDataFrame(DISTRICTS, DISTRICT_SHAPE)


def frame(spark, points, category="a"):
    rows = [(i, f"r{i}", category, "d", float(a), float(b), 1) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, SHAPE)


# -- plain implementations ------------------------------------------------------------


def vec(lat, lng):
    a, b = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], -1)


def brute_dbscan(points, eps, min_points):
    v = vec(points[:, 0], points[:, 1])
    near = ((v[:, None] - v[None]) ** 2).sum(-1) <= geo.chord(eps) ** 2
    core = near.sum(1) >= min_points
    label = [None] * len(points)
    cluster = 0
    for seed in range(len(points)):
        if not core[seed] or label[seed] is not None:
            continue
        stack = [seed]
        while stack:
            p = stack.pop()
            if label[p] is not None:
                continue
            label[p] = cluster
            if core[p]:
                stack += [q for q in np.flatnonzero(near[p]) if label[q] is None]
        cluster += 1
    return {(i, c) for i, c in enumerate(label) if c is not None}


def brute_dedup(points, radius):
    n = len(points)
    keep, group = [], list(range(n))
    lat, lng = np.radians(points[:, 0]), np.radians(points[:, 1])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lng[:, None] - lng) / 2) ** 2
    near = 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1, h))) <= radius
    seen = set()
    for i in range(n):
        if i in seen:
            continue
        keep.append(i)
        stack = [i]
        while stack:
            p = stack.pop()
            if p in seen:
                continue
            seen.add(p)
            stack += [q for q in np.flatnonzero(near[p]) if q not in seen]
    return keep


def dense_points(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = np.array([[10.0, 20.0], [10.02, 20.01], [-89.9995, 40.0], [5.0, 179.9995], [0.0, 0.0]])
    return centres[rng.integers(0, 5, n)] + rng.normal(0, spread, (n, 2))


# -- fixed values ---------------------------------------------------------------------


def test_dbscan_small(reports):
    rows = dbscan(reports, 50.0, 2).summary().collect()
    assert len(rows) == 1 and rows[0].memberCount == 3
    assert abs(rows[0].lat - 28.6139333333) < 1e-5


def test_dbscan_all_within_reach(spark):
    # Points with a known result.
    points = [(28.61390, 77.209), (28.61420, 77.209), (28.61421, 77.209), (28.61422, 77.209)]
    rows = dbscan(frame(spark, points), 40.0, 3).summary().collect()
    assert [r.memberCount for r in rows] == [4]


def test_border_point_joins_lowest_cluster_and_noise_is_left_out(spark):
    step = 30 / 111_195.0
    # Two groups of four; a point between them reaches one end of each and is not core.
    group = [0, 0.1, 0.2, 0.3]
    right = [(0.0, (2.25 + g) * step) for g in group]
    left = [(0.0, g * step) for g in group]
    points = [(0.0, 1.28 * step), *right, *left, (1.0, 1.0)]
    members = {(r.ord, r.clusterId, r.core) for r in dbscan(frame(spark, points), 30.0, 4).members().collect()}
    assert members == {(0, 0, False), *((i, 0, True) for i in range(1, 5)), *((i, 1, True) for i in range(5, 9))}


def test_dedup_small(reports):
    rows = dedup_reports(reports, 30.0).orderBy("ord").collect()
    assert [r.id for r in rows] == ["c1", "c3", "c4"]


def test_dedup_is_transitive_and_by_category(spark):
    step = 40 / 111_195.0
    chain = frame(spark, [(0, 0), (0, step), (0, 2 * step)])
    assert [r.id for r in dedup_reports(chain, 50.0).collect()] == ["r0"]
    other = chain.withColumn("category", F.when(F.col("ord") == 1, "b").otherwise("a"))
    assert dedup_reports(other, 50.0).count() == 3


def test_radius_limits(reports, spark):
    assert dedup_reports(reports, 0).count() == 4
    with pytest.raises(ValueError):
        dedup_reports(reports, -1)
    with pytest.raises(ValueError):
        dbscan(reports, 0, 3)
    with pytest.raises(ValueError):
        dbscan(reports, 10, 0)
    assert dedup_reports(reports.limit(0), 50.0).count() == 0
    assert dbscan(reports.limit(0), 50.0, 2).members().count() == 0


def test_aggregate_and_ranking(reports, districts):
    north = aggregate_by_district(reports).filter("districtId = 'north'").first()
    assert (north.complaintCount, north.severitySum, north.topCategory) == (3, 12.0, "roads")
    assert [tuple(e) for e in north.categoryFrequency] == [("roads", 2), ("water", 1)]
    first = top_districts(reports, districts, 1).collect()
    assert [(r.districtId, r.priorityScore) for r in first] == [("north", 6.0)]
    assert top_districts(reports, districts, 0).count() == 0


def test_ties_in_score_and_category(spark, districts):
    rows = [(i, f"t{i}", c, d, 0.0, 0.0, 2) for i, (c, d) in enumerate([("water", "south"), ("roads", "south"), ("roads", "east"), ("water", "east")])]
    flat = districts.withColumn("infraScore", F.lit(0.5))
    ranked = top_districts(spark.createDataFrame(rows, SHAPE), flat, 5).collect()
    assert [(r.districtId, r.topCategory, r.priorityScore) for r in ranked] == [("east", "roads", 4.0), ("south", "roads", 4.0)]


def test_nearest_small(spark, districts):
    point = spark.createDataFrame([(1, 28.6140, 77.2090)], "id int, lat double, lng double")
    found = near_mod.nearest_district(point, districts).first()
    assert found.districtId == "north" and found.distanceMeters < 20
    with pytest.raises(ValueError):
        near_mod.nearest_district(point, districts.limit(0))


# -- brute force ----------------------------------------------------------------------


@pytest.mark.parametrize("min_points,hot_rows,direct", [(4, 10**6, None), (5, 20, 0), (1, 10**6, None)])
def test_dbscan_matches_brute_force(spark, min_points, hot_rows, direct):
    points = dense_points(min_points, 500, 0.004)
    df = frame(spark, points).orderBy(F.rand(3))
    found = {(r.ord, r.clusterId) for r in dbscan(df, 250.0, min_points, hot_rows=hot_rows, direct_pairs=direct).members().collect()}
    assert found == brute_dbscan(points, 250.0, min_points)


@pytest.mark.parametrize("hot_rows,direct", [(10**6, None), (15, 0)])
def test_dedup_matches_brute_force(spark, hot_rows, direct):
    # A third of the reports lie at one place.
    points = np.concatenate([dense_points(9, 300, 0.002), np.tile([[10.0, 20.0]], (150, 1))])
    df = frame(spark, points).orderBy(F.rand(5))
    found = sorted(r.ord for r in dedup_reports(df, 60.0, hot_rows=hot_rows, direct_pairs=direct).collect())
    assert found == brute_dedup(points, 60.0)


def test_radius_join_matches_brute_force(spark):
    points = dense_points(4, 300, 0.003)
    v = vec(points[:, 0], points[:, 1])
    angle = 2 * np.arcsin(np.minimum(1, np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) / 2)) * geo.EARTH_RADIUS_M
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if angle[i, j] <= 300}
    for hot_rows in (10**6, 10):
        pairs = radius_join(frame(spark, points), 300.0, hot_rows=hot_rows).collect()
        assert {(r.a_ord, r.b_ord) for r in pairs} == want and len(pairs) == len(want)


def test_components_of_chain_and_star(spark):
    nodes = spark.range(400).toDF("node")
    chain = nodes.filter("node < 199").selectExpr("node AS src", "node + 1 AS dst")
    star = nodes.filter("node > 300").selectExpr("node AS src", "300L AS dst")
    edges = chain.union(star)
    for hot_rows, tail in ((10**6, 10**5), (10**6, 0), (5, 0), (5, 60)):
        labels = {r.node: r.label for r in connected_components(nodes, edges, hot_rows=hot_rows, tail_links=tail).collect()}
        assert labels == {i: 0 if i < 200 else i if i < 300 else 300 for i in range(400)}


@pytest.mark.parametrize("count,short", [(25, 64), (300, 4)])
def test_nearest_matches_brute_force(spark, monkeypatch, count, short):
    monkeypatch.setattr(near_mod, "SHORT_LIST", short)
    rng = np.random.default_rng(count)
    pts = pd.DataFrame({"id": range(400), "lat": rng.uniform(-90, 90, 400), "lng": rng.uniform(-180, 180, 400)})
    pts.loc[:30, "lat"] = rng.uniform(88, 90, 31)
    dim = pd.DataFrame({"ord": range(count), "id": [f"d{i:04d}" for i in range(count)], "name": "n", "country": "c", "state": "s",
                        "lat": rng.uniform(-80, 80, count), "lng": rng.uniform(-180, 180, count), "infraScore": 1.0})
    if count > 100:  # a crowd of districts at one place
        dim.loc[:150, ["lat", "lng"]] = [40, 20] + rng.normal(0, 0.001, (151, 2))
    v, w = vec(pts.lat.values, pts.lng.values), vec(dim.lat.values, dim.lng.values)
    want = dim.id.values[((v[:, None] - w[None]) ** 2).sum(-1).argmin(1)]
    sp, sd = spark.createDataFrame(pts), spark.createDataFrame(dim)
    got = near_mod.nearest_district(sp, sd).toPandas().sort_values("id")
    assert (got.districtId.values == want).all() and len(got) == 400
    d_lng = (pts.lng.values[:, None] - dim.lng.values) * np.cos(np.radians(pts.lat.values))[:, None]
    flat = dim.id.values[((pts.lat.values[:, None] - dim.lat.values) ** 2 + d_lng**2).argmin(1)]
    got = near_mod.nearest_district_planar(sp, sd, "id").toPandas().sort_values("id")
    assert (got.districtId.values == flat).all()


def test_nearest_of_many_districts(spark):
    """20,000 points and districts, a third of the districts in one town: no level pairs all cells with all districts."""
    rng = np.random.default_rng(8)
    n = 20_000
    pts = pd.DataFrame({"id": range(n), "lat": rng.uniform(-90, 90, n), "lng": rng.uniform(-180, 180, n)})
    dim = pd.DataFrame({"ord": range(n), "id": [f"d{i:05d}" for i in range(n)], "name": "n", "country": "c", "state": "s",
                        "lat": rng.uniform(-80, 80, n), "lng": rng.uniform(-180, 180, n), "infraScore": 1.0})
    dim.loc[: n // 3, ["lat", "lng"]] = [40, 20] + rng.normal(0, 0.05, (n // 3 + 1, 2))
    pts.loc[: n // 3, ["lat", "lng"]] = [40, 20] + rng.normal(0, 0.05, (n // 3 + 1, 2))
    some = rng.choice(n, 400, replace=False)
    v, w = vec(pts.lat.values[some], pts.lng.values[some]), vec(dim.lat.values, dim.lng.values)
    want = dim.id.values[((v[:, None] - w[None]) ** 2).sum(-1).argmin(1)]
    got = near_mod.nearest_district(spark.createDataFrame(pts), spark.createDataFrame(dim)).toPandas().sort_values("id")
    assert len(got) == n and (got.districtId.values[some] == want).all()


@pytest.mark.parametrize("count", [1, 40, 700])
def test_prepared_index_equals_search(spark, tmp_path, count):
    """An index built without the points gives every point its nearest district, poles and crowds included."""
    rng = np.random.default_rng(count)
    pts = pd.DataFrame({"id": range(900), "lat": rng.uniform(-90, 90, 900), "lng": rng.uniform(-180, 180, 900)})
    pts.loc[:4, ["lat", "lng"]] = [[90, 0], [-90, 10], [0, 180], [0, -180], [0, 0]]
    dim = pd.DataFrame({"ord": range(count), "id": [f"d{i:04d}" for i in range(count)], "name": "n", "country": "c", "state": "s",
                        "lat": rng.uniform(-80, 80, count), "lng": rng.uniform(-180, 180, count), "infraScore": 1.0})
    if count > 100:
        dim.loc[:300, ["lat", "lng"]] = [40, 20] + rng.normal(0, 0.01, (301, 2))
        pts.loc[5:200, ["lat", "lng"]] = [40, 20] + rng.normal(0, 0.01, (196, 2))
    v, w = vec(pts.lat.values, pts.lng.values), vec(dim.lat.values, dim.lng.values)
    want = dim.id.values[((v[:, None] - w[None]) ** 2).sum(-1).argmin(1)]
    index = near_mod.NearestIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    got = index.build(spark.createDataFrame(dim)).attach(spark.createDataFrame(pts)).selectExpr("id", "best.id AS d").toPandas().sort_values("id")
    assert index.exists() and len(got) == 900 and (got.d.values == want).all()


def test_hotspots_end_to_end(reports, districts):
    ranked, clusters = hotspots(reports, districts, k=2, radius_m=50.0, min_points=2)
    rows = ranked.orderBy(F.desc("priorityScore")).collect()
    assert [r.districtId for r in rows] == ["north", "south"]
    assert rows[0].recommendation.startswith("Prioritize targeted road rehabilitation")
    assert [(c.districtId, c.memberCount) for c in clusters.collect()] == [("north", 2)]
