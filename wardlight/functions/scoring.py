"""Severity and priority expressions, evaluated in doubles from left to right."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _level(value: Column, five: str, four: str, two: str) -> Column:
    return F.when(value == five, 5.0).when(value == four, 4.0).when(value == two, 2.0).otherwise(1.0)


def effective_severity(base: Column, urgency: Column, scale: Column, duration: Column) -> Column:
    """The classifier's severity, weighted with the reporter's answers if there are any."""
    weighted = (
        F.lit(0.4) * base.cast("double")
        + F.lit(0.3) * _level(urgency, "emergency", "high", "medium")
        + F.lit(0.2) * _level(scale, "wide_area", "neighbourhood", "street")
        + F.lit(0.1) * _level(duration, "over_6_months", "1_to_6_months", "1_to_4_weeks")
    )
    rounded = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(weighted + F.lit(0.5)).cast("int")))
    unanswered = F.coalesce(F.nullif(urgency, F.lit("")), F.nullif(scale, F.lit("")), F.nullif(duration, F.lit("")))
    return F.when(unanswered.isNull(), base.cast("int")).otherwise(rounded)


def reference_id(timestamp: Column, key: Column) -> Column:
    """``CP-YYYY-NNNNNN`` with six digits taken from an integer key."""
    return F.format_string("CP-%04d-%06d", F.year(timestamp), F.pmod(key, F.lit(1_000_000)))


def id_number(key: Column) -> Column:
    """A well-spread integer for a text id."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def priority_score(count: Column, severity_sum: Column, infra_score: Column) -> Column:
    mean = severity_sum / count
    return count * mean / F.greatest(F.coalesce(infra_score, F.lit(1.0)), F.lit(1.0))


def mask_anonymous(df):
    """Remove user and phone from anonymous reports."""
    hidden = F.coalesce(F.col("isAnonymous"), F.lit(False))
    return df.withColumns({c: F.when(~hidden, F.col(c)) for c in ("userId", "contactPhone")})
