"""Model output as data: checked classifications and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight import domain
from wardlight.functions.display import recommendation_text
from wardlight.functions.text import label, trim_spaces
from wardlight.operators import joins

_ANY = "category string, severity string, summary string, tags string, detectedLanguage string, translatedText string"


def sanitize_enrichment(rows: DataFrame, json: str = "json") -> DataFrame:
    """Add ``enrichment`` = struct<category, severity, summary, tags, detectedLanguage, translatedText>.

    Null unless the object has a known category and language tag, a numeric severity,
    string summary and translation, and an array of only strings as tags.
    """
    # The variant keeps JSON types, which decide between a number and a numeric string.
    doc = F.try_parse_json(F.col(json))

    def kind(path: str):
        return F.schema_of_variant(F.try_variant_get("_doc", path, "variant"))

    def text(path: str):
        return F.when(kind(path) == "STRING", F.try_variant_get("_doc", path, "string"))

    number = F.when(
        kind("$.severity").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get("_doc", "$.severity", "double")
    )
    tags = F.when(
        kind("$.tags").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get("_doc", "$.tags", "array<string>")
    )
    language = label(text("$.detectedLanguage"), domain.MODEL_LANGUAGE_TAGS)
    category, summary, translated = text("$.category"), text("$.summary"), text("$.translatedText")
    sound = (
        category.isin(domain.MODEL_CATEGORIES) & number.isNotNull() & summary.isNotNull()
        & tags.isNotNull() & ~F.exists(tags, lambda t: t.isNull()) & language.isNotNull() & translated.isNotNull()
    )
    clean = F.struct(
        category.alias("category"),
        F.greatest(F.lit(1), F.least(F.lit(5), F.floor(number + F.lit(0.5)).cast("int"))).alias("severity"),
        F.substring(summary, 1, 500).alias("summary"),
        F.transform(F.slice(tags, 1, 5), lambda t: F.substring(trim_spaces(t), 1, 40)).alias("tags"),
        language.alias("detectedLanguage"),
        F.substring(translated, 1, 5000).alias("translatedText"),
    )
    return rows.withColumn("_doc", doc).withColumn("enrichment", F.when(sound, clean)).drop("_doc")


def merge_recommendations(hotspots: DataFrame, responses: DataFrame | None = None, json: str = "json") -> DataFrame:
    """Add ``recommendation``: the last usable text given for the district, else the template.

    ``responses`` holds JSON objects with a ``recommendations`` array and an ``ord``
    column that orders several responses.
    """
    template = recommendation_text(
        F.col("topCategory"), F.col("complaintCount"), F.col("avgSeverity"), F.col("priorityScore")
    )
    if responses is None:
        return hotspots.withColumn("recommendation", template)

    def text(path: str):
        # Only JSON strings count; a number is no text.
        string = F.schema_of_variant(F.try_variant_get("item", path, "variant")) == "STRING"
        return F.when(string, F.try_variant_get("item", path, "string"))

    given = (
        responses.select("ord", F.try_variant_get(F.try_parse_json(F.col(json)), "$.recommendations", "array<variant>").alias("r"))
        .select("ord", F.posexplode("r").alias("pos", "item"))
        .select("ord", "pos", text("$.districtId").alias("districtId"), trim_spaces(text("$.recommendation")).alias("text"))
        .filter("districtId IS NOT NULL AND text <> ''")
    )
    last = given.groupBy("districtId").agg(F.max_by(F.substring("text", 1, 600), F.struct("ord", "pos")).alias("_given"))
    return hotspots.join(last, "districtId", "left").withColumn(
        "recommendation", F.coalesce("_given", template)
    ).drop("_given")
