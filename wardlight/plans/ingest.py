"""From submissions as received to stored reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from wardlight import domain
from wardlight.functions import scoring
from wardlight.operators import joins
from wardlight.operators.districts import assign_district, ensure_district_rows
from wardlight.operators.nearest import NearestIndex
from wardlight.operators.validation import conform_severity, split_valid, validate_complaints
from wardlight.plans.classify import classify_reports
from wardlight.workspace import Workspace


def ingest_reports(
    submissions: DataFrame, districts: DataFrame, catalog: DataFrame, workspace: Workspace | None = None,
    index_of: Callable[[DataFrame], NearestIndex] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored reports, rejects, districts).

    A catalog district that the reporter chose is kept; if ``districts`` has no row for
    it, the returned districts do, at the place of its first report.  Other reports go to
    the nearest of the returned districts.

    ``submissions`` has the columns of ``validate_complaints`` plus ``id, userId,
    timestamp, isAnonymous, photoUrls`` and, if there is model output, ``enrichment``.
    ``index_of`` gives a prepared index over the returned districts.
    """
    ws = workspace or Workspace(submissions.sparkSession)
    # Read several times below: validate once.
    checked = ws.write(validate_complaints(submissions, catalog), "checked")
    valid, rejects = split_valid(checked)
    known = ws.write(known_districts(valid, districts, catalog), "districts")
    return finish_reports(valid, known, ws, index_of(known) if index_of else None), rejects, known


def known_districts(reports: DataFrame, districts: DataFrame, catalog: DataFrame) -> DataFrame:
    """``districts`` and a row for each chosen catalog district; catalog names win for catalog ids."""
    chosen = reports.withColumn("districtId", F.nullif("districtId", F.lit("")))
    rows = ensure_district_rows(chosen, districts, catalog)
    names = catalog.select(F.col("districtId").alias("id"), F.col("districtName").alias("_name"), F.col("stateName").alias("_state"))
    return joins.lookup(rows, names, "id", "left").withColumns(
        {"name": F.coalesce("_name", "name"), "state": F.coalesce("_state", "state")}
    ).select(*rows.columns)


def finish_reports(
    valid: DataFrame, districts: DataFrame, workspace: Workspace | None = None, index: NearestIndex | None = None
) -> DataFrame:
    """Classify, place, score and shape rows that passed validation.

    A report's own ``districtId`` wins if ``districts`` has it.
    """
    placed = classify_reports(assign_district(valid, districts, workspace, index))
    c = F.col("classification")
    scored = scoring.mask_anonymous(
        placed.withColumns(
            {
                "severity": conform_severity(scoring.effective_severity(
                    c["severity"], F.col("urgency"), F.col("affectedScale"), F.col("duration")
                )),
                "isAnonymous": F.coalesce("isAnonymous", F.lit(False)),
                "referenceId": scoring.reference_id(F.col("timestamp"), scoring.id_number(F.col("id"))),
            }
        )
    )
    return scored.select(
        "id", "userId", F.lit("submitted").alias("status"), F.col("text").alias("rawText"),
        c["translatedText"].alias("translatedText"), c["detectedLanguage"].alias("detectedLanguage"),
        c["category"].alias("category"), c["classifiedBy"].alias("classifiedBy"), c["tags"].alias("tags"),
        "severity", "districtId", "lat", "lng", "timestamp",
        F.coalesce("source", F.lit("text")).alias("source"),
        F.nullif("userCategory", F.lit("")).alias("userCategory"), "urgency", "duration", "affectedScale",
        "landmark", "stateName", "photoUrls", "contactPhone", "isAnonymous", "referenceId",
    ).to(domain.COMPLAINT)
