"""The flagship pipeline: duplicates out, clusters, ranking, enrichment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wardlight.functions import scoring
from wardlight.operators import joins
from wardlight.operators.aggregates import aggregate_by_district, dedup_metrics, top_districts
from wardlight.operators.clustering import dbscan, dedup_reports
from wardlight.operators.districts import lookup_district
from wardlight.operators.enrichment import merge_recommendations
from wardlight.operators.nearest import nearest_district_planar
from wardlight.operators.validation import conform_clusters, conform_hotspots
from wardlight.workspace import Workspace


@dataclass
class Analysis:
    unique: DataFrame
    clusters: DataFrame
    top: DataFrame
    metrics: DataFrame


def analyze(
    complaints: DataFrame, districts: DataFrame, k: int = 5, duplicate_radius_m: float = 50.0,
    radius_m: float = 1500.0, min_points: int = 3, workspace: Workspace | None = None,
) -> Analysis:
    """Collapse duplicates, cluster and rank the remaining reports.

    Needs ``ord, id, category, districtId, lat, lng, severity``.
    """
    ws = workspace or Workspace(complaints.sparkSession)
    slim = complaints.select("ord", "id", "category", "districtId", "lat", "lng", "severity")
    unique = ws.write(dedup_reports(slim, duplicate_radius_m, ws), "unique")
    clusters = dbscan(unique, radius_m, min_points, ws)
    return Analysis(
        unique=unique,
        clusters=clusters.summary(),
        top=top_districts(unique, districts, k),
        metrics=dedup_metrics(slim, unique),
    )


def enrich_clusters(
    clusters: DataFrame, complaints: DataFrame, districts: DataFrame, workspace: Workspace | None = None
) -> DataFrame:
    """Give each cluster its nearest district and that district's figures over all given reports.

    Clusters whose district has no report are dropped.
    """
    return clusters_with_figures(clusters, aggregate_by_district(complaints), districts, workspace)


def clusters_with_figures(
    clusters: DataFrame, figures: DataFrame, districts: DataFrame, workspace: Workspace | None = None
) -> DataFrame:
    """:func:`enrich_clusters` from the districts' figures."""
    ws = workspace or Workspace(clusters.sparkSession)
    near = nearest_district_planar(clusters, districts, "clusterId", ws)
    figures = ws.write(figures.drop("categoryFrequency"), "figures")
    placed = clusters.join(near, "clusterId")
    return joins.lookup(placed, figures, "districtId").select(
        "clusterId", "districtId", "districtName", "country", "lat", "lng", "memberCount",
        scoring.priority_score(F.col("complaintCount"), F.col("severitySum"), F.col("infraScore")).alias("priorityScore"),
        (F.col("severitySum") / F.col("complaintCount")).alias("avgSeverity"), "topCategory",
    )


def hotspots(
    complaints: DataFrame, districts: DataFrame, k: int = 5, recommendations: DataFrame | None = None,
    dedup_for_clusters: bool = False, workspace: Workspace | None = None, **radii,
) -> tuple[DataFrame, DataFrame]:
    """(ranked districts with recommendation, enriched clusters).

    Ranking uses the reports without duplicates, cluster figures use all reports unless
    ``dedup_for_clusters``.
    """
    ws = workspace or Workspace(complaints.sparkSession)
    found = analyze(complaints, districts, k, workspace=ws, **radii)
    ranked = recommended(found.top, districts, recommendations)
    clusters = enrich_clusters(
        ws.write(conform_clusters(found.clusters), "clusters"),
        found.unique if dedup_for_clusters else complaints, districts, ws,
    )
    return ranked, clusters


def recommended(top: DataFrame, districts: DataFrame, recommendations: DataFrame | None = None) -> DataFrame:
    """Ranked districts with their place and recommendation."""
    ranked = lookup_district(conform_hotspots(top.drop("districtName", "categoryFrequency")), districts)
    return merge_recommendations(ranked, recommendations).select(
        "districtId", "districtName", "country", "lat", "lng", "priorityScore", "topCategory",
        "complaintCount", "avgSeverity", "recommendation",
    )
