"""Dashboard statistics, filters, facets and chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight import domain
from wardlight.functions import display
from wardlight.operators import joins
from wardlight.workspace import Workspace


def stats(
    complaints: DataFrame, districts: DataFrame, count_all_languages: bool = False, workspace: Workspace | None = None
) -> DataFrame:
    """Long-form ``dimension, key, n``.

    Dimensions: total, category (zero-filled), language (zero-filled; ``or`` and
    ``hi-Latn`` are only counted with ``count_all_languages``), country, districts.
    """
    ws = workspace or Workspace(complaints.sparkSession)
    # Every dimension reads the counts: write them, so that the reports are read once.
    return stats_from_counts(ws.write(count_reports(complaints), "counts"), districts, count_all_languages)


def count_reports(complaints: DataFrame) -> DataFrame:
    """Reports per category, language and district: one partially aggregated pass over the rows."""
    return complaints.groupBy("category", "detectedLanguage", "districtId").agg(F.count("*").alias("n"))


def stats_from_counts(counts: DataFrame, districts: DataFrame, count_all_languages: bool = False) -> DataFrame:
    spark = counts.sparkSession
    counted = domain.LANGUAGES if count_all_languages else domain.COUNTED_LANGUAGES

    def filled(dimension: str, column: str, keys: list[str], counted_keys: list[str]) -> DataFrame:
        keys_df = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
        seen = counts.filter(F.col(column).isin(counted_keys)).groupBy(F.col(column).alias("key")).agg(F.sum("n").alias("n"))
        return keys_df.join(seen, "key", "left").select(F.lit(dimension).alias("dimension"), "key", F.coalesce("n", F.lit(0)).alias("n"))

    country = districts.select(F.col("id").alias("districtId"), "country")
    per_district = counts.groupBy("districtId").agg(F.sum("n").alias("n"))
    countries = (
        joins.lookup(per_district, country, "districtId", "left")
        .groupBy(F.coalesce("country", F.lit("Unknown")).alias("key")).agg(F.sum("n").alias("n"))
        .select(F.lit("country").alias("dimension"), "key", "n")
    )
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("dimension"), F.lit("").alias("key"), "n"
    )
    covered = per_district.agg(F.count("*").alias("n")).select(
        F.lit("districts").alias("dimension"), F.lit("").alias("key"), "n"
    )
    return (
        total.unionByName(filled("category", "category", domain.CATEGORIES, domain.CATEGORIES))
        .unionByName(filled("language", "detectedLanguage", domain.LANGUAGES, counted))
        .unionByName(countries).unionByName(covered)
    )


def kpis(stats_rows: DataFrame, hotspots: DataFrame) -> DataFrame:
    """``name, n``: languages in use and high-priority districts."""
    languages = stats_rows.agg(
        F.count_if((F.col("dimension") == "language") & (F.col("n") > 0)).alias("n")
    ).select(F.lit("languages").alias("name"), "n")
    high = hotspots.agg(F.count_if(F.col("priorityScore") >= 12).alias("n")).select(
        F.lit("highPriority").alias("name"), "n"
    )
    return languages.unionByName(high)


def filter_hotspots(rows: DataFrame, country: str = "all", category: str = "all", min_severity: float = 1) -> DataFrame:
    """Dashboard filter for ranked districts and clusters; ``"all"`` switches a condition off."""
    fits: Column = F.col("avgSeverity") >= min_severity
    if country != "all":
        fits = fits & (F.col("country") == country)
    if category != "all":
        fits = fits & (F.col("topCategory") == category)
    return rows.filter(fits)


def facet_counts(rows: DataFrame) -> DataFrame:
    """``facet, key, n``: rows per country, per category and per severity threshold 1 to 5."""
    thresholds = F.sequence(F.lit(1), F.least(F.lit(5), F.floor("avgSeverity").cast("int")))
    facets = F.array(
        F.struct(F.lit("country").alias("facet"), F.col("country").alias("key")),
        F.struct(F.lit("category").alias("facet"), F.col("topCategory").alias("key")),
    )
    severities = F.when(
        F.col("avgSeverity") >= 1,
        F.transform(thresholds, lambda t: F.struct(F.lit("severity").alias("facet"), t.cast("string").alias("key"))),
    )
    each = F.explode(F.concat(facets, F.coalesce(severities, F.array().cast("array<struct<facet:string,key:string>>"))))
    return rows.select(each.alias("f")).groupBy("f.facet", "f.key").agg(F.count("*").alias("n"))


def chart_series(stats_rows: DataFrame, country: str = "all", category: str = "all") -> DataFrame:
    """``chart, name, value`` of the category and country charts, without zeros."""
    chosen = F.col("n") > 0
    cat = (F.col("dimension") == "category") & (F.lit(category == "all") | (F.col("key") == category))
    cou = (F.col("dimension") == "country") & (F.lit(country == "all") | (F.col("key") == country))
    return stats_rows.filter(chosen & (cat | cou)).select(
        F.col("dimension").alias("chart"),
        F.when(F.col("dimension") == "category", display.category_label(F.col("key"))).otherwise(F.col("key")).alias("name"),
        F.col("n").alias("value"),
    )


def country_names(stats_rows: DataFrame) -> DataFrame:
    """Countries with reports, ascending."""
    return stats_rows.filter("dimension = 'country' AND n > 0").select(F.col("key").alias("country")).distinct().orderBy("country")
