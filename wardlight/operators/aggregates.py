"""District aggregates, ranking and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.functions import scoring
from wardlight.operators import joins


def category_counts(complaints: DataFrame) -> DataFrame:
    """Reports and severity per district and category: the only shuffle of report rows."""
    return complaints.groupBy(
        F.coalesce("districtId", F.lit("")).alias("districtId"), F.coalesce("category", F.lit("")).alias("category")
    ).agg(F.count("*").alias("n"), F.sum(F.col("severity").cast("double")).alias("severity"))


def aggregate_by_district(complaints: DataFrame) -> DataFrame:
    """``districtId, complaintCount, severitySum, topCategory, categoryFrequency``.

    The frequency is a sorted array of (category, n); the top category is the most
    frequent one, of equals the smallest by bytes.
    """
    return district_figures(category_counts(complaints))


def district_figures(counts: DataFrame) -> DataFrame:
    """:func:`aggregate_by_district` from one row per district and category."""
    return counts.groupBy("districtId").agg(
        F.sum("n").alias("complaintCount"),
        F.sum("severity").alias("severitySum"),
        F.min(F.struct((-F.col("n")).alias("rank"), "category")).getField("category").alias("topCategory"),
        F.array_sort(F.collect_list(F.struct("category", "n"))).alias("categoryFrequency"),
    )


def frequency_text(frequency) -> "F.Column":
    """A category frequency as ``a=1,b=2``."""
    return F.array_join(
        F.transform(frequency, lambda e: F.concat(e["category"], F.lit("="), e["n"].cast("string"))), ","
    )


def score_districts(aggregates: DataFrame, districts: DataFrame) -> DataFrame:
    """Join aggregates to known districts and add average severity and priority score."""
    known = districts.select(
        F.col("id").alias("districtId"), F.col("name").alias("districtName"), "infraScore"
    )
    return joins.lookup(aggregates, known, "districtId").select(
        "districtId", "districtName",
        scoring.priority_score(F.col("complaintCount"), F.col("severitySum"), F.col("infraScore")).alias("priorityScore"),
        (F.col("severitySum") / F.col("complaintCount")).alias("avgSeverity"),
        "complaintCount", "topCategory", "categoryFrequency",
    )


def top_districts(complaints: DataFrame, districts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` districts of highest priority, of equals the smaller id first."""
    return rank_figures(aggregate_by_district(complaints), districts, k)


def rank_figures(figures: DataFrame, districts: DataFrame, k: int) -> DataFrame:
    scored = score_districts(figures, districts)
    return scored.orderBy(F.desc("priorityScore"), F.asc("districtId")).limit(k)


def dedup_metrics(complaints: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: ``uniqueComplaintCount, duplicatesRemoved``."""
    counts = complaints.select(F.lit(1).alias("raw"), F.lit(0).alias("kept")).unionAll(
        unique.select(F.lit(0).alias("raw"), F.lit(1).alias("kept"))
    )
    return counts.agg(
        F.coalesce(F.sum("kept"), F.lit(0)).alias("uniqueComplaintCount"),
        F.coalesce(F.sum("raw") - F.sum("kept"), F.lit(0)).alias("duplicatesRemoved"),
    )


def resolved_by_user(complaints: DataFrame) -> DataFrame:
    """Submitted and resolved reports per user."""
    return complaints.filter(F.col("userId").isNotNull()).groupBy("userId").agg(
        F.count("*").alias("submitted"), F.count_if(F.col("status") == "resolved").alias("resolved")
    )
