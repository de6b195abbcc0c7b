"""Classification of report texts by user choice, keywords, model output or default."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.functions import text as tx
from wardlight.operators import joins
from wardlight.workspace import Workspace

MIN_CONFIDENCE = 0.85
DEFAULT_SUMMARY = "Infrastructure issue reported."
MIN_PREVIEW_CHARS = 15
#: Bytes of classification results that may be broadcast.
BROADCAST_BYTES = 64 << 20


def classify_reports(df: DataFrame, text: str = "text", hint: str = "language", user_category: str = "userCategory") -> DataFrame:
    """Add struct ``classification`` to rows with a text, a language hint and a user category.

    An ``enrichment`` column (see ``sanitize_enrichment``) supplies model output where
    present.  Fields: category, severity, summary, tags, translatedText,
    detectedLanguage, classifiedBy, confidence (keyword hits only).
    """
    if "enrichment" not in df.columns:
        df = df.withColumn(
            "enrichment",
            F.lit(None).cast(
                "struct<category:string,severity:int,summary:string,tags:array<string>,"
                "detectedLanguage:string,translatedText:string>"
            ),
        )
        drop = ["enrichment"]
    else:
        drop = []
    # Each expensive scan is its own column, so later references do not repeat it.
    rows = tx.keyword_classify(df, text, "_keyword").withColumn("_script", tx.detect_script(F.col(text))["code"])
    rows = rows.withColumn("_local", tx.resolve_language(F.col("_script"), F.col(hint), F.col(text)))

    trusted = ~F.col("_script").isin("en", "hi-Latn")
    given = F.col("enrichment")
    by_user = F.col(user_category).isNotNull() & (F.col(user_category) != "")
    by_keyword = F.coalesce(F.col("_keyword.confidence") >= MIN_CONFIDENCE, F.lit(False))
    branch = (
        F.when(by_user, "user").when(by_keyword, "trie").when(given.isNotNull(), "model").otherwise("fallback")
    )
    opening = F.coalesce(F.nullif(F.substring(tx.trim_spaces(F.col(text)), 1, 300), F.lit("")), F.lit(DEFAULT_SUMMARY))
    uses_model = F.col("_branch").isin("user", "model")
    none = F.array().cast("array<string>")
    language = (
        F.when(F.col("_branch").isin("trie", "fallback") | trusted, F.col("_local"))
        .when(F.col("_branch") == "user", F.coalesce(F.col(hint), given["detectedLanguage"], F.col("_local")))
        .otherwise(F.coalesce(F.col(hint), given["detectedLanguage"]))
    )
    result = F.struct(
        F.when(F.col("_branch") == "user", F.col(user_category))
        .when(F.col("_branch") == "trie", F.col("_keyword.category"))
        .when(F.col("_branch") == "model", given["category"])
        .otherwise("roads").alias("category"),
        F.coalesce(F.when(uses_model, given["severity"]), F.lit(3)).alias("severity"),
        F.when(F.col("_branch") == "trie", F.col("_keyword.summary"))
        .otherwise(F.coalesce(F.when(uses_model, given["summary"]), opening)).alias("summary"),
        F.coalesce(F.when(uses_model, given["tags"]), none).alias("tags"),
        F.coalesce(F.when(uses_model, given["translatedText"]), F.col(text)).alias("translatedText"),
        language.alias("detectedLanguage"),
        F.col("_branch").alias("classifiedBy"),
        F.when(F.col("_branch") == "trie", F.col("_keyword.confidence")).alias("confidence"),
    )
    return rows.withColumn("_branch", branch).withColumn("classification", result).drop(
        "_keyword", "_script", "_local", "_branch", *drop
    )


def classify_once_per_text(
    df: DataFrame, text: str = "text", hint: str = "language", user_category: str = "userCategory",
    hot_rows: int = joins.HOT_ROWS, workspace: Workspace | None = None,
) -> DataFrame:
    """Like :func:`classify_reports`, but each distinct fingerprint is classified once.

    All rows of a fingerprint get the result of one of their texts (the smallest).
    """
    ws = workspace or Workspace(df.sparkSession)
    # The fingerprints are read three times below: compute them once.
    marked = ws.write(
        df.withColumn("_print", tx.text_fingerprint(F.col(text), F.col(hint), F.nullif(F.col(user_category), F.lit("")))),
        "prints",
    )
    inputs = [text, hint, user_category, *(["enrichment"] if "enrichment" in df.columns else [])]
    sample = marked.groupBy("_print").agg(F.min(F.struct(*inputs)).alias("s")).select("_print", "s.*")
    results = ws.write(classify_reports(sample, text, hint, user_category).select("_print", "classification"), "results")
    # Results hold whole texts: their bytes decide about a broadcast, not their number.
    size = results.agg(F.sum(F.octet_length(F.to_json("classification")))).first()[0] or 0
    few = joins.BROADCAST_ROWS if size <= BROADCAST_BYTES else 0
    return joins.lookup(marked, results, "_print", broadcast_rows=few, hot_rows=hot_rows).drop("_print")


def preview_category(df: DataFrame, text: str = "text") -> DataFrame:
    """Category preview for texts of at least 15 characters; null where only the default applies."""
    trimmed = df.withColumn(text, tx.trim_spaces(F.col(text))).filter(F.length(text) >= MIN_PREVIEW_CHARS)
    blank = trimmed.withColumns({"_hint": F.lit(None).cast("string"), "_user": F.lit(None).cast("string")})
    c = F.col("classification")
    decided = c["classifiedBy"] != "fallback"
    return classify_reports(blank, text, "_hint", "_user").withColumns(
        {
            "category": F.when(decided, c["category"]),
            "confidence": c["confidence"],
            "classifiedBy": F.when(decided, c["classifiedBy"]),
        }
    ).drop("_hint", "_user", "classification")
