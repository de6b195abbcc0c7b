"""Report store: overlays, upserts, lookups, paging and the status log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight import domain
from wardlight.functions import display
from wardlight.functions.text import trim_spaces


def overlay_union(base: DataFrame, overlay: DataFrame, prefer: str = "base") -> DataFrame:
    """Union by ``id``; where both have an id, the preferred side's row stays."""
    if prefer not in ("base", "overlay"):
        raise ValueError("prefer must be 'base' or 'overlay'")
    first, second = (base, overlay) if prefer == "base" else (overlay, base)
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"))


def upsert_complaints(rows: DataFrame, version: str) -> DataFrame:
    """The last write per ``id`` by ``version``; aggregated before the shuffle, so repeated ids are cheap."""
    payload = F.struct(*[c for c in rows.columns if c != "id"])
    return rows.groupBy("id").agg(F.max_by(payload, version).alias("r")).select("id", "r.*").select(*rows.columns)


def get_complaint(complaints: DataFrame, wanted: str) -> DataFrame:
    """The report with this id, or else with this reference id; at most one row."""
    match = F.col("id") == wanted
    by_reference = F.lit(wanted).rlike(domain.REFERENCE_ID_PATTERN) & (F.col("referenceId") == wanted)
    return complaints.filter(match | by_reference).orderBy(F.when(match, 0).otherwise(1), "id").limit(1)


def resolve_complaints(requests: DataFrame, complaints: DataFrame) -> DataFrame:
    """Batch form: ``wanted, complaintId`` for a table of ids or reference ids (null if unknown)."""
    by_id = complaints.select(F.col("id").alias("wanted"), F.col("id").alias("_direct"))
    by_ref = complaints.filter(F.col("referenceId").isNotNull()).groupBy(F.col("referenceId").alias("wanted")).agg(
        F.min("id").alias("_ref")
    )
    asked = requests.select("wanted").distinct()
    fits = F.col("wanted").rlike(domain.REFERENCE_ID_PATTERN)
    return asked.join(by_id, "wanted", "left").join(by_ref, "wanted", "left").select(
        "wanted", F.coalesce("_direct", F.when(fits, F.col("_ref"))).alias("complaintId")
    )


def my_reports(complaints: DataFrame, user_id: str) -> DataFrame:
    return complaints.filter(F.col("userId") == user_id)


class UnknownCursor(ValueError):
    """The cursor is malformed, or its report is missing or belongs to another user."""


def page_reports(
    complaints: DataFrame, limit: int = 20, cursor: str | None = None, user_id: str | None = None
) -> DataFrame:
    """One page, newest first and then by id, with the ``nextCursor`` of the page on every row.

    ``limit`` must be from 1 to 100.
    """
    size = int(limit)
    if not 1 <= size <= 100:
        raise ValueError("limit must be from 1 to 100")
    rows = complaints if user_id is None else my_reports(complaints, user_id)
    if cursor is not None:
        spark = complaints.sparkSession
        decoded = spark.range(1).select(display.decode_cursor(F.lit(cursor)).alias("id")).first()["id"]
        at = rows.filter(F.col("id") == decoded).select("id", "timestamp").first() if decoded else None
        if at is None:
            raise UnknownCursor("cursor report was not found")
        ts = F.lit(at["timestamp"])
        rows = rows.filter((F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("id") > at["id"])))
    return _page(rows, size)


def _page(rows: DataFrame, size: int) -> DataFrame:
    newest = rows.orderBy(F.desc("timestamp"), F.asc("id")).limit(size + 1)
    # Over at most 101 rows: number them, and take the cursor of the last one kept.
    columns = rows.columns
    listed = newest.agg(
        F.sort_array(F.collect_list(F.struct((-F.unix_micros("timestamp")).alias("_t"), F.col("id").alias("_i"), F.struct(*columns).alias("_r")))).alias("all")
    )
    more = F.size("all") > size
    return listed.select(
        F.posexplode(F.slice("all", 1, size)).alias("position", "e"),
        F.when(more, display.encode_cursor(F.element_at(F.slice("all", 1, size), -1)["_i"])).alias("nextCursor"),
    ).select("position", *[F.col(f"e._r.{c}").alias(c) for c in columns], "nextCursor")


def moderation_queue(complaints: DataFrame, limit: int = 20) -> DataFrame:
    """The newest reports with their display columns."""
    return page_reports(complaints, limit).select(
        "position", "id",
        display.summarize_text(F.col("rawText"), 150).alias("summary"),
        display.pretty_district(F.col("districtId")).alias("district"),
        display.category_label(F.col("category")).alias("categoryLabel"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
        display.classifier_label(F.col("classifiedBy")).alias("classifier"),
        display.urgency_label(F.col("urgency")).alias("urgencyLabel"),
        display.scale_label(F.col("affectedScale")).alias("scaleLabel"),
        F.replace(F.col("duration"), F.lit("_"), F.lit(" ")).alias("durationText"),
        F.coalesce(F.nullif("referenceId", F.lit("")), "id").alias("reference"),
    )


def clean_status_events(events: DataFrame) -> DataFrame:
    """Keep events with a known status and a note of at most 500 characters; blank notes become null."""
    note = trim_spaces(F.col("note"))
    return events.filter(F.col("status").isin(domain.STATUSES)).filter(
        F.col("note").isNull() | (F.length("note") <= 500)
    ).withColumn("note", F.when(note != "", note))


def event_fault() -> Column:
    """Why a status event cannot be taken, whichever report it names: status or note; null if it can."""
    fine = F.coalesce(F.col("status").isin(domain.STATUSES), F.lit(False))
    return F.when(~fine, "status").when(F.length("note") > 500, "note")


def names_of_reports(complaints: DataFrame) -> DataFrame:
    """``wanted, _report, _rank``: each report's id (rank 0) and reference id (rank 1), read in one pass."""
    def name(column: str, rank: int) -> Column:
        return F.struct(F.col(column).alias("wanted"), F.col("id").alias("_report"), F.lit(rank).alias("_rank"))

    return complaints.select(F.inline(F.array(name("id", 0), name("referenceId", 1)))).filter(
        (F.col("_rank") == 0) | F.col("wanted").rlike(domain.REFERENCE_ID_PATTERN)
    )


def first_of_name(names: DataFrame) -> DataFrame:
    """``wanted, _report``: the report of each name, by rank, then the smallest id."""
    return names.groupBy("wanted").agg(F.min(F.struct("_rank", "_report"))["_report"].alias("_report"))


def report_names(complaints: DataFrame) -> DataFrame:
    """``wanted, _report``: every name that a report answers to, its id first, else its reference id."""
    return first_of_name(names_of_reports(complaints))


def resolve_events(events: DataFrame, complaints: DataFrame) -> DataFrame:
    """Events with ``complaintId`` as the report's id, given its id or reference id; null if unknown."""
    names = report_names(complaints).withColumnRenamed("wanted", "complaintId")
    found = events.join(names, "complaintId", "left")
    return found.withColumn("complaintId", F.col("_report")).select(*events.columns)


def rejected_status_events(events: DataFrame, complaints: DataFrame) -> DataFrame:
    """Events that :func:`status_history` leaves out, with ``reason``: status, note or complaintId."""
    names = report_names(complaints).withColumnRenamed("wanted", "complaintId")
    reason = F.coalesce(event_fault(), F.when(F.col("_report").isNull(), "complaintId"))
    return events.join(names, "complaintId", "left").withColumn("reason", reason).filter("reason IS NOT NULL").select(
        *events.columns, "reason"
    )


def status_history(events: DataFrame, complaints: DataFrame) -> DataFrame:
    """Distinct history entries of known reports, one row each, ordered by ``updatedAt, seq``.

    ``events`` has ``complaintId, seq, updatedAt, status, adminId, note``; ``complaintId``
    is a report's id or reference id, and the id in the result.  Equal entries collapse to
    the last ``seq``; see :func:`rejected_status_events` for events that are left out.
    """
    known = resolve_events(clean_status_events(events), complaints).filter("complaintId IS NOT NULL")
    return known.groupBy("complaintId", "updatedAt", "status", "adminId", "note").agg(F.max("seq").alias("seq"))


def current_status(history: DataFrame) -> DataFrame:
    """Status, last note, time of the last change and number of entries per report.

    Only running maxima are kept per report, however long its history is.
    """
    order = F.struct("updatedAt", "seq")
    return history.groupBy("complaintId").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("note", F.when(F.col("note").isNotNull(), order)).alias("adminNote"),
        F.max("updatedAt").alias("updatedAt"),
        F.count("*").alias("entries"),
    )


def fold_status_events(events: DataFrame, complaints: DataFrame) -> DataFrame:
    """Report documents: the current status with the whole history as one ordered array.

    A document must fit in a row; use :func:`status_history` and :func:`current_status`
    where a report may have collected more events than that.
    """
    history = status_history(events, complaints)
    arrays = history.groupBy("complaintId").agg(
        F.array_sort(F.collect_list(F.struct("updatedAt", "seq", "status", "adminId", "note"))).alias("history")
    )
    return current_status(history).drop("entries").join(arrays, "complaintId")
