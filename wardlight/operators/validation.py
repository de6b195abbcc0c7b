"""Checks that split submissions into valid rows and rejects, and guards for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight import domain
from wardlight.functions.text import trim_spaces
from wardlight.operators import joins

MAX_TEXT = 5000
MAX_LANDMARK = 200
MAX_PHOTOS = 3


#: Decimal numbers; the cast alone would also take a type suffix, as in 12.5f.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def _coordinate(value: Column, limit: float) -> Column:
    text = trim_spaces(value.cast("string"))
    number = F.when(text.rlike(_NUMBER), text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) <= limit), number)


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def validate_complaints(submissions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``errors`` (failed rules in order) and typed ``text, lat, lng``.

    ``submissions`` holds strings as received: ``text, lat, lng, source, language,
    userCategory, urgency, duration, affectedScale, landmark, contactPhone, stateName,
    districtId`` and ``photoCount``.  Use :func:`split_valid` on the result.
    """
    states = catalog.select(F.lower("stateName").alias("_stateKey")).distinct().withColumn("_stateKnown", F.lit(True))
    units = catalog.select(F.col("districtId")).distinct().withColumn("_unitKnown", F.lit(True))
    rows = submissions.withColumn("_stateKey", F.lower(trim_spaces(F.col("stateName"))))
    rows = joins.lookup(joins.lookup(rows, states, "_stateKey", "left"), units, "districtId", "left")

    text = trim_spaces(F.col("text"))
    lat, lng = _coordinate(F.col("lat"), 90.0), _coordinate(F.col("lng"), 180.0)
    rules = [
        ("text", F.coalesce((text != "") & (F.length("text") <= MAX_TEXT), F.lit(False))),
        ("lat", lat.isNotNull()),
        ("lng", lng.isNotNull()),
        ("source", F.col("source").isNull() | F.col("source").isin(domain.SOURCES)),
        ("language", F.col("language").isNull() | F.col("language").isin(domain.LANGUAGES)),
        ("userCategory", ~_given("userCategory") | F.col("userCategory").isin(domain.CATEGORIES)),
        ("urgency", ~_given("urgency") | F.col("urgency").isin(domain.URGENCIES)),
        ("duration", ~_given("duration") | F.col("duration").isin(domain.DURATIONS)),
        ("affectedScale", ~_given("affectedScale") | F.col("affectedScale").isin(domain.SCALES)),
        ("landmark", ~_given("landmark") | (F.length("landmark") <= MAX_LANDMARK)),
        ("contactPhone", ~_given("contactPhone") | F.col("contactPhone").rlike(domain.PHONE_PATTERN)),
        ("stateName", ~_given("stateName") | F.col("_stateKnown").isNotNull()),
        ("districtId", ~_given("districtId") | F.col("_unitKnown").isNotNull()),
        ("photos", F.coalesce("photoCount", F.lit(0)) <= MAX_PHOTOS),
    ]
    failed = F.array_compact(F.array(*[F.when(~passed, F.lit(name)) for name, passed in rules]))
    return rows.withColumns({"errors": failed, "text": text, "lat": lat, "lng": lng}).drop(
        "_stateKey", "_stateKnown", "_unitKnown"
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with ``reason`` = first failed rule)."""
    valid = validated.filter(F.size("errors") == 0).drop("errors")
    rejects = validated.filter(F.size("errors") > 0).withColumn("reason", F.col("errors")[0])
    return valid, rejects


def conform_severity(value: Column) -> Column:
    """The severity; the query fails if it is no whole number from 1 to 5."""
    fine = F.coalesce((value == F.floor(value)) & value.between(1, 5), F.lit(False))
    return F.when(fine, value).otherwise(F.raise_error(F.lit("invalid severity")).cast("int"))


def conform_hotspots(hotspots: DataFrame) -> DataFrame:
    """Fail the query if a ranked row breaks the result schema or vocabulary."""
    fine = (
        F.col("districtId").isNotNull() & F.col("priorityScore").isNotNull()
        & F.coalesce(F.col("topCategory").isin(domain.CATEGORIES), F.lit(False))
        & F.col("complaintCount").isNotNull() & F.col("avgSeverity").isNotNull()
    )
    return _guard(hotspots, fine, "invalid ranked district")


def conform_clusters(clusters: DataFrame) -> DataFrame:
    """Fail the query if a cluster row lacks id, centroid or member count."""
    fine = F.lit(True)
    for name in ("clusterId", "lat", "lng", "memberCount"):
        fine = fine & F.col(name).isNotNull()
    return _guard(clusters, fine, "invalid cluster")


def _guard(df: DataFrame, fine: Column, message: str) -> DataFrame:
    return df.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
