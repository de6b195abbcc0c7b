"""Hotspots kept up to date batch by batch, reading only what a batch can change.

Reports lie in grid cells.  Cells whose boxes come within the larger of the two radii
are linked, and the components of linked cells are places: no report has a duplicate or
a cluster neighbour outside its own place.  Reports are only ever added, so boxes grow,
links appear and places merge, but none falls apart.  A batch therefore

1. adds its reports to the summaries of the cells they touch,
2. links those cells with their neighbours and merges the places that meet,
3. finds duplicates and clusters anew inside these places, and nowhere else,
4. replaces the places' shares of the counts and clusters, from which the ranking follows.

Cells and reports are bucketed by tiles of the grid, results by place; a batch opens only
the buckets of its places, and all tables change in one commit.  A place that spans a
whole region is recomputed as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlight.functions import geo
from wardlight.operators import joins
from wardlight.operators.aggregates import district_figures, rank_figures
from wardlight.operators.cells import AXES, CELL, REACH, Grid, near_by_chord, neighbour_pairs
from wardlight.operators.clustering import dbscan, dedup_reports
from wardlight.operators.components import connected_components
from wardlight.operators.ranking import number_rows
from wardlight.operators.validation import conform_clusters
from wardlight.plans.hotspots import clusters_with_figures, recommended
from wardlight.sources.buckets import BUCKETS, BucketStore, Snapshot, bucket_of
from wardlight.workspace import Workspace

#: log2 of the cells per tile edge.
TILE_BITS = 5
#: Tables of a batch that are written side by side, while it goes on.
WRITERS = 4

_REPORT = "ord long, category string, districtId string, lat double, lng double, severity double"
_CELL = "cx long, cy long, cz long"
_BOX = ", ".join(f"lo_{a} double, hi_{a} double" for a in AXES)
_COUNT = "districtId string, category string, n long, severity double, kept long, keptSeverity double"
TABLES = {
    "reports": f"bucket int, {_REPORT}, {_CELL}",
    "cells": f"bucket int, {_CELL}, place long, n long, {_BOX}",
    "places": "bucket int, place long, tiles array<int>",
    "unique": "bucket int, place long, ord long",
    "counts": f"bucket int, place long, {_COUNT}",
    "totals": f"bucket int, {_COUNT}",
    "clusters": "bucket int, place long, label long, lat double, lng double, memberCount long",
}
_SUMS = ("n", "severity", "kept", "keptSeverity")


class LiveHotspots:
    """The stored reports of a stream and the hotspots over all of them.

    Reports need ``ord, category, districtId, lat, lng, severity``; ``ord`` is unique
    over all batches and gives the input order, in which batches need not arrive.
    Reports without finite coordinates are counted, and are in no place.
    """

    def __init__(
        self, spark: SparkSession, path: str, duplicate_radius_m: float = 50.0, radius_m: float = 1500.0, min_points: int = 3,
        buckets: int = BUCKETS,
    ):
        self.spark, self.store, self.buckets = spark, BucketStore(spark, path, TABLES), buckets
        self.duplicate_radius_m, self.radius_m, self.min_points = duplicate_radius_m, radius_m, min_points
        widest = max(duplicate_radius_m, radius_m)
        self.grid = Grid(widest, near_by_chord(widest))

    # -- a batch -----------------------------------------------------------------------

    def add(self, batch: DataFrame, version: int, workspace: Workspace | None = None) -> dict[str, int]:
        """Take up a batch as ``version``; a version that is taken up again replaces itself.

        Returns how many stored reports were read again, and how many the batch had.
        """
        ws = workspace or Workspace(self.spark)
        change = self.store.change(version)
        located = geo.located("lat", "lng")
        slim = batch.selectExpr(
            "CAST(ord AS BIGINT) AS ord", "category", "districtId", "CAST(lat AS DOUBLE) AS lat", "CAST(lng AS DOUBLE) AS lng",
            "CAST(severity AS DOUBLE) AS severity",
        )
        slim = ws.write(slim, "batch")
        placed = replace(self.grid, keys=["category", "districtId", "severity"]).place(slim.filter(located))
        rows = ws.write(placed.withColumn("bucket", self._tile(*CELL)), "placed")

        cells, moved, tiles = self._merge_places(change, rows, ws)
        # Cells of the batch's places; every other stored report stays unread.
        hit = ws.write(cells.filter("hit").select(*CELL, "place", "bucket"), "hit")
        stored = change.read("reports", tiles).drop("bucket")
        with ThreadPoolExecutor(WRITERS) as writers:
            writes = []

            def beside(write: Callable[..., None], *what) -> None:
                writes.append(writers.submit(inheritable_thread_target(self.spark)(write), *what))

            beside(change.append, "reports", rows)
            beside(change.replace, "cells", cells, tiles)
            both = stored.unionByName(rows.select(*stored.columns))
            mine = ws.write(joins.lookup(both, hit.select(*CELL, "place"), CELL), "mine")
            self._replace_results(change, mine, hit, moved, slim.filter(~located), version, ws, beside)
        for written in writes:
            written.result()
        change.commit()
        return {"read": mine.count() - rows.count(), "added": slim.count()}

    def _tile(self, x: str, y: str, z: str):
        return bucket_of(*[F.shiftright(F.col(c), TILE_BITS) for c in (x, y, z)], buckets=self.buckets)

    def _bucket(self, column: str = "place"):
        return bucket_of(column, buckets=self.buckets)

    def _near_tiles(self, touched: DataFrame) -> list[int]:
        """Tiles within reach of cells; at most ``buckets`` numbers."""
        for c in CELL:
            span = F.sequence(F.shiftright(F.col(c) - REACH, TILE_BITS), F.shiftright(F.col(c) + REACH, TILE_BITS))
            touched = touched.withColumn(f"t{c}", F.explode(span))
        tile = bucket_of(*[f"t{c}" for c in CELL], buckets=self.buckets)
        return [r.t for r in touched.select(tile.alias("t")).distinct().collect()]

    def _merge_places(self, change: Snapshot, rows: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame, list[int]]:
        """All cells of the tiles to rewrite, the map from old to new places, and those tiles."""
        boxes = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
        touched = ws.write(rows.groupBy("bucket", *CELL).agg(F.min("ord").alias("fresh"), F.count("*").alias("n"), *boxes), "touched")
        grown = [f(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
        # A new cell is a place of its own, named by its first report, until links say otherwise.
        current = ws.write(
            change.read("cells", self._near_tiles(touched)).unionByName(touched, allowMissingColumns=True)
            .groupBy("bucket", *CELL).agg(
                F.coalesce(F.max("place"), F.min("fresh")).alias("place"), F.sum("n").alias("n"),
                F.max(F.col("fresh").isNotNull()).alias("touched"), *grown,
            ),
            "current",
        )
        changed = current.filter("touched")
        pairs = neighbour_pairs(self.grid, changed, current)
        links = ws.write(pairs.select(F.col("a_place").alias("src"), F.col("b_place").alias("dst")).distinct(), "links")
        nodes = changed.select("place").union(links.select("dst")).distinct().toDF("node")
        moved = connected_components(nodes, links, ws).toDF("place", "to")

        known = change.read("places", self._buckets_of(moved.select("place")))
        tiles = known.join(moved, "place", "left_semi").select(F.explode("tiles").alias("t")).union(changed.select("bucket"))
        tiles = [r.t for r in tiles.distinct().collect()]
        others = change.read("cells", tiles).join(changed.select(*CELL), CELL, "left_anti")
        cells = others.unionByName(changed.drop("touched")).join(moved, "place", "left")
        cells = cells.withColumns({"hit": F.col("to").isNotNull(), "place": F.coalesce("to", "place")}).drop("to")
        return ws.write(cells, "cells"), moved, tiles

    def _buckets_of(self, places: DataFrame) -> list[int]:
        return [r.b for r in places.select(self._bucket(places.columns[0]).alias("b")).distinct().collect()]

    def _replace_results(self, change, mine, hit, moved, lost, version, ws, beside) -> None:
        unique = ws.write(dedup_reports(mine, self.duplicate_radius_m, ws), "unique")
        # Rows without coordinates are nobody's neighbours; each batch has a name for its own.
        lost = lost.withColumn("place", F.lit(-1 - version).cast("long"))
        counts = ws.write(_counts(mine.unionByName(lost, allowMissingColumns=True), unique.unionByName(lost, allowMissingColumns=True)), "counts")
        gone = moved.select("place").union(counts.select("place")).distinct()
        buckets = self._buckets_of(gone)

        def after(table: str, rows: DataFrame) -> DataFrame:
            others = change.read(table, buckets).join(gone, "place", "left_anti")
            return others.unionByName(rows.withColumn("bucket", self._bucket()))

        def replace_counts() -> None:
            rows = ws.write(after("counts", counts), "allcounts")
            totals = rows.groupBy("bucket", "districtId", "category").agg(*[F.sum(c).alias(c) for c in _SUMS])
            change.replace("totals", totals, buckets)
            change.replace("counts", rows, buckets)

        places = hit.groupBy("place").agg(F.sort_array(F.collect_set("bucket")).alias("tiles"))
        beside(change.replace, "places", after("places", places), buckets)
        beside(change.replace, "unique", after("unique", unique.select("place", "ord")), buckets)
        beside(replace_counts)
        clusters = dbscan(unique, self.radius_m, self.min_points, ws).labelled()
        clusters = clusters.join(unique.select(F.col("ord").alias("label"), "place"), "label")
        change.replace("clusters", after("clusters", clusters), buckets)

    # -- results -----------------------------------------------------------------------

    def unique_reports(self, version: int | None = None) -> DataFrame:
        """``ord`` of the located reports that are nobody's later duplicate."""
        return self.store.snapshot(version).read("unique").select("ord")

    def clusters(self, version: int | None = None) -> DataFrame:
        """``clusterId, lat, lng, memberCount``, numbered by first core report."""
        found = self.store.snapshot(version).read("clusters").select("label", "lat", "lng", "memberCount")
        return number_rows(found, "label", "clusterId", Workspace(self.spark)).select("clusterId", "lat", "lng", "memberCount")

    def results(
        self, districts: DataFrame, k: int = 5, recommendations: DataFrame | None = None, version: int | None = None,
        workspace: Workspace | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """(ranked districts, enriched clusters) over all reports, as :func:`wardlight.plans.hotspots.hotspots` gives them."""
        ws = workspace or Workspace(self.spark)
        sums = self.store.snapshot(version).read("totals").groupBy("districtId", "category").agg(*[F.sum(c).alias(c) for c in _SUMS])
        sums = ws.write(sums, "sums")
        kept = sums.filter("kept > 0").select("districtId", "category", F.col("kept").alias("n"), F.col("keptSeverity").alias("severity"))
        top = rank_figures(district_figures(kept), districts, k)
        clusters = ws.write(conform_clusters(self.clusters(version)), "clusters")
        figures = district_figures(sums.select("districtId", "category", "n", "severity"))
        return recommended(top, districts, recommendations), clusters_with_figures(clusters, figures, districts, ws)


def _counts(rows: DataFrame, unique: DataFrame) -> DataFrame:
    """Reports and severity per place, district and category: all, and without duplicates."""
    def slim(df: DataFrame, all_: int, kept: int) -> DataFrame:
        return df.select(
            "place", F.coalesce("districtId", F.lit("")).alias("districtId"), F.coalesce("category", F.lit("")).alias("category"),
            F.lit(all_).cast("long").alias("n"), (F.col("severity") * all_).alias("severity"),
            F.lit(kept).cast("long").alias("kept"), (F.col("severity") * kept).alias("keptSeverity"),
        )

    both = slim(rows, 1, 0).unionByName(slim(unique, 0, 1))
    return both.groupBy("place", "districtId", "category").agg(*[F.sum(c).alias(c) for c in _SUMS])
