"""Display expressions of the dashboard and report lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardlight import domain
from wardlight.functions.text import collapse_spaces, label


def summarize_text(text: Column, longest: int = 150) -> Column:
    """One line of text, cut to ``longest`` - 3 characters and an ellipsis if longer."""
    clean = collapse_spaces(text)
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest - 3), F.lit("…"))).otherwise(clean)


def pretty_district(district_id: Column) -> Column:
    """Drop the ``in-`` prefix, hyphens to spaces, capitals at word starts (``_`` is part of a word)."""
    spaced = F.regexp_replace(F.regexp_replace(district_id, "^in-", ""), "-", " ")
    # Break before each word start, then raise the first letter of each piece.
    pieces = F.split(spaced, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), ""
    )


def category_label(category: Column) -> Column:
    return label(category, domain.CATEGORY_LABELS)


def status_label(status: Column) -> Column:
    return label(status, domain.STATUS_LABELS)


def classifier_label(classified_by: Column) -> Column:
    return label(F.coalesce(classified_by, F.lit("fallback")), domain.CLASSIFIER_LABELS)


def scale_label(scale: Column) -> Column:
    return label(scale, domain.SCALE_LABELS)


def urgency_label(urgency: Column) -> Column:
    return label(urgency, domain.URGENCY_LABELS)


def duration_label(duration: Column) -> Column:
    return label(duration, domain.DURATION_LABELS)


def one_decimal(value: Column) -> Column:
    """A non-negative double with one decimal, rounded from its exact value, ties upwards.

    Ten times the fraction is formed as an exact sum of two doubles, because a plain
    product would turn values just below a tie (1.45) into the tie.
    """
    value = value.cast("double")
    whole = F.floor(value)
    part = value - whole
    a, b = part * 8.0, part * 2.0
    tenths = a + b
    lost = (a - (tenths - (tenths - a))) + (b - (tenths - a))
    over = tenths - F.floor(tenths) - 0.5
    up = F.when((over > 0) | ((over == 0) & (lost >= 0)), 1).otherwise(0)
    digits = whole * 10 + F.floor(tenths) + up
    return F.concat(
        F.floor(digits / 10).cast("string"), F.lit("."), F.pmod(digits, F.lit(10)).cast("string")
    )


def recommendation_text(category: Column, count: Column, severity: Column, score: Column) -> Column:
    """The template recommendation for a ranked district."""
    return F.concat(
        F.lit("Prioritize "), label(category, domain.PROJECT_PHRASES), F.lit(". "),
        count.cast("string"), F.lit(" reports average severity "), one_decimal(severity),
        F.lit(" and a priority score of "), one_decimal(score), F.lit("."),
    )


def priority_tone(score: Column) -> Column:
    return F.when(score >= 12, "High priority").when(score >= 5, "Medium priority").otherwise("Lower priority")


def marker_radius(members: Column) -> Column:
    return F.greatest(F.lit(7.0), F.least(F.lit(23.0), F.lit(6.0) + F.sqrt(members) * F.lit(2.2)))


def ring_progress(score: Column) -> Column:
    return F.greatest(F.lit(0.08), F.least(F.lit(1.0), score / F.lit(20.0)))


def encode_cursor(value: Column) -> Column:
    """base64url without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(value, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """The encoded text, or null if the cursor is not one that :func:`encode_cursor` writes."""
    well_formed = cursor.rlike("^[A-Za-z0-9_-]+$") & (F.length(cursor) % 4 != 1)
    padded = F.concat(F.translate(cursor, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(cursor), F.lit(4))))
    raw = F.unbase64(F.when(well_formed, padded))
    decoded = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when((F.length(decoded) > 0) & (encode_cursor(decoded) == cursor), decoded)
