"""Spatial duplicates, density clusters and radius pairs.

All order comes from an ``ord`` column (a unique integer giving the input order), never
from the physical order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.functions import geo
from wardlight.operators import joins
from wardlight.operators.cells import (
    CELL, Grid, labelled_cells, near_by_chord, near_by_haversine, neighbour_pairs, point_boxes, prefixed,
)
from wardlight.operators.ranking import number_rows
from wardlight.workspace import Workspace


def radius_join(
    df: DataFrame, radius_m: float, same_keys: list[str] | None = None, hot_rows: int = joins.HOT_ROWS
) -> DataFrame:
    """Pairs ``a_ord < b_ord`` at most ``radius_m`` apart (inclusive), with their distance.

    With ``same_keys``, only rows that agree on them pair.  Columns: ``a_ord, b_ord,
    distance_m`` and the keys.  The result itself holds every near pair; use
    :func:`dedup_reports` or :func:`dbscan` where only groups are wanted.
    """
    keys = list(same_keys or [])
    edge = max(geo.chord(radius_m) * 2.0, 1e-12)
    reach = geo.chord(radius_m) * (1 + 1e-9) + 1e-14
    axes = dict(zip(CELL, "xyz"))
    vector = [f"{v} AS {a}" for v, a in zip(geo.unit_vector_sql("lat", "lng"), "xyz")]
    points = df.select("ord", *keys, "lat", "lng").selectExpr("*", *vector)

    def cell_of(axis: str, shift: float) -> str:
        return f"CAST(floor(({axis} + {shift!r}D) / {edge!r}D) AS BIGINT)"

    homes = points.selectExpr("*", *[f"{cell_of(a, 0.0)} AS {c}" for c, a in axes.items()])
    copies = prefixed(points, "b", keys)
    for cell, axis in axes.items():
        copies = copies.selectExpr(
            "*", f"explode(sequence({cell_of(f'b_{axis}', -reach)}, {cell_of(f'b_{axis}', reach)})) AS {cell}"
        )
    hot = homes.groupBy(*keys, *CELL).count().filter(F.col("count") > hot_rows)
    hot = hot if joins.has_rows(hot) else None
    pairs = joins.join_group_rows(copies, prefixed(homes, "a", keys + CELL), keys + CELL, "a_ord", hot)
    distance = geo.haversine_sql("a_lat", "a_lng", "b_lat", "b_lng")
    return (
        pairs.filter("a_ord < b_ord")
        .selectExpr(*keys, "a_ord", "b_ord", f"{distance} AS distance_m")
        .filter(f"distance_m <= {float(radius_m)!r}D")
    )


def dedup_reports(
    df: DataFrame,
    radius_m: float = 50.0,
    workspace: Workspace | None = None,
    hot_rows: int = joins.HOT_ROWS,
    direct_pairs: int | None = None,
) -> DataFrame:
    """Keep the first report of every chain of same-category reports within ``radius_m``.

    Needs ``ord, category, lat, lng``; the other columns pass through.  Reports without
    finite coordinates are nobody's duplicates and stay.
    """
    if radius_m < 0:
        raise ValueError("the duplicate radius cannot be negative")
    if radius_m == 0:
        return df
    everything, df = df, df.filter(geo.located("lat", "lng"))
    ws = workspace or Workspace(df.sparkSession)
    grid = Grid(radius_m, near_by_haversine(radius_m), ["_category"], hot_rows)
    if direct_pairs is not None:
        grid.direct_pairs = direct_pairs
    # A null category is a value like any other here.
    keyed = df.withColumn("_category", F.coalesce("category", F.lit("\0")))
    points = ws.write(grid.place(keyed), "points")
    cells = ws.write(grid.summarise(points), "cells")
    labels = labelled_cells(grid, points, cells, ws)
    first = labels.filter(F.col("node") == F.col("label")).select(F.col("node").alias("ord"))
    return df.join(first, "ord", "left_semi").select(*df.columns).unionByName(everything.filter(~geo.located("lat", "lng")))


def dbscan(
    df: DataFrame,
    eps_m: float = 1500.0,
    min_points: int = 3,
    workspace: Workspace | None = None,
    hot_rows: int = joins.HOT_ROWS,
    direct_pairs: int | None = None,
) -> "Clusters":
    """Density clusters of the points ``ord, lat, lng``.

    A point with at least ``min_points`` points within ``eps_m`` (itself included) is
    core.  Clusters are the components of core points within ``eps_m``, numbered by
    their first core point; a border point joins the lowest-numbered cluster it touches.
    Points without finite coordinates are in no cluster.
    """
    if eps_m <= 0 or min_points <= 0:
        raise ValueError("eps_m and min_points must be positive")
    df = df.filter(geo.located("lat", "lng"))
    ws = workspace or Workspace(df.sparkSession)
    grid = Grid(eps_m, near_by_chord(eps_m), [], hot_rows)
    if direct_pairs is not None:
        grid.direct_pairs = direct_pairs
    points = ws.write(grid.place(df), "points")
    cells = ws.write(grid.summarise(points), "cells")
    hot = grid.hot_cells(cells)
    dense = cells.filter(F.col("n") >= min_points)

    if min_points == 1:
        core_cells, core_points = dense, points
        sparse = contacts = None
    else:
        sparse, contacts = _sparse_contacts(grid, points, cells, hot, min_points, ws)
        sparse = ws.write(_with_degree(grid, sparse, contacts, points, hot, min_points), "sparse")
        sparse_core = sparse.filter("core").drop("core", "n")
        core_cells = ws.write(dense.unionByName(grid.summarise(sparse_core)), "corecells")
        in_dense = points.join(sparse.select("ord"), "ord", "left_anti")
        core_points = in_dense.unionByName(sparse_core.select(*points.columns))

    labels = labelled_cells(grid, core_points, core_cells, ws)
    core_cells = core_cells.join(labels, "node")
    ranks = number_rows(labels.filter(F.col("node") == F.col("label")).select("label"), "label", "clusterId", ws)
    border = None
    if sparse is not None:
        border = _border(grid, sparse, contacts, core_cells, core_points, hot)
    return Clusters(grid, points, core_cells, core_points, border, ranks, hot)


class Clusters:
    """Result of :func:`dbscan`; both views are lazy."""

    def __init__(self, grid, points, core_cells, core_points, border, ranks, hot):
        self._grid, self._points, self._border = grid, points, border
        self._core_cells, self._core_points, self._ranks, self._hot = core_cells, core_points, ranks, hot

    def members(self) -> DataFrame:
        """``ord, clusterId, core`` of every clustered point; noise is left out."""
        by_cell = self._core_cells.select(*CELL, "label")
        core = joins.join_group_rows(
            by_cell, self._core_points.select("ord", *CELL), CELL, "ord", self._hot
        ).select("ord", "label", F.lit(True).alias("core"))
        rows = core
        if self._border is not None:
            rows = rows.unionByName(self._border.select("ord", "label", F.lit(False).alias("core")))
        return rows.join(self._ranks, "label").select("ord", "clusterId", "core")

    def summary(self) -> DataFrame:
        """``clusterId, lat, lng, memberCount``; computed from cell sums, not from members."""
        return self.labelled().join(self._ranks, "label").select("clusterId", "lat", "lng", "memberCount")

    def labelled(self) -> DataFrame:
        """``label, lat, lng, memberCount``: clusters by the ``ord`` of their first core point."""
        parts = self._core_cells.select("label", "sum_lat", "sum_lng", "n")
        if self._border is not None:
            parts = parts.unionByName(
                self._border.select(
                    "label", F.col("lat").alias("sum_lat"), F.col("lng").alias("sum_lng"), F.lit(1).cast("long").alias("n")
                )
            )
        totals = parts.groupBy("label").agg(
            F.sum("sum_lat").alias("a"), F.sum("sum_lng").alias("b"), F.sum("n").alias("memberCount")
        )
        return totals.select(
            "label", (F.col("a") / F.col("memberCount")).alias("lat"),
            (F.col("b") / F.col("memberCount")).alias("lng"), "memberCount",
        )


def _sparse_contacts(grid, points, cells, hot, min_points, ws):
    """Points of cells below ``min_points`` and the other cells within their reach."""
    thin = cells.filter(F.col("n") < min_points).select(*CELL, "n")
    cold = points if hot is None else points.join(F.broadcast(hot), CELL, "left_anti")
    sparse = cold.join(thin, CELL)
    pairs = neighbour_pairs(
        grid,
        point_boxes(sparse.select("ord", "lat", "lng", "x", "y", "z", *CELL)),
        cells.drop("sum_lat", "sum_lng"),
    ).selectExpr("*", grid.verdict("a", "b") + " AS near")
    contacts = pairs.select(
        F.col("a_ord").alias("ord"), F.col("a_lat"), F.col("a_lng"), "near",
        F.col("b_n"), *[F.col(f"b_{c}").alias(c) for c in CELL],
    )
    return sparse, ws.write(contacts, "contacts")


def _with_degree(grid, sparse, contacts, points, hot, min_points) -> DataFrame:
    """Mark the sparse points that have enough neighbours."""
    sure = contacts.filter("near").groupBy("ord").agg(F.sum("b_n").alias("sure"))
    known = sparse.join(sure, "ord", "left").withColumn("sure", F.col("n") + F.coalesce("sure", F.lit(0)))
    ask = contacts.filter("near is null").join(
        known.filter(F.col("sure") < min_points).select("ord"), "ord", "left_semi"
    ).select("ord", "a_lat", "a_lng", *CELL)
    held = points.select(*CELL, F.col("ord").alias("b_ord"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    met = joins.join_group_rows(ask, held, CELL, "b_ord", hot).filter(grid.near("a", "b"))
    counted = met.groupBy("ord").agg(F.count("*").alias("met"))
    degree = F.col("sure") + F.coalesce("met", F.lit(0))
    return known.join(counted, "ord", "left").withColumn("core", degree >= min_points).drop("sure", "met")


def _border(grid, sparse, contacts, core_cells, core_points, hot) -> DataFrame:
    """Non-core points next to a core point, with the lowest label they touch."""
    outer = sparse.filter(~F.col("core"))
    in_cells = core_cells.select(*CELL, "label")
    own = outer.join(in_cells, CELL).select("ord", "label")
    touched = contacts.join(outer.select("ord"), "ord", "left_semi").join(in_cells, CELL)
    sure = touched.filter("near").select("ord", "label")
    held = core_points.select(
        *CELL, F.col("ord").alias("b_ord"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng")
    )
    ask = touched.filter("near is null").select("ord", "label", "a_lat", "a_lng", *CELL)
    met = joins.join_group_rows(ask, held, CELL, "b_ord", hot).filter(grid.near("a", "b")).select("ord", "label")
    lowest = own.union(sure).union(met).groupBy("ord").agg(F.min("label").alias("label"))
    return lowest.join(outer.select("ord", "lat", "lng"), "ord")
