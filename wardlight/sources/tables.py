"""Readers for report, district and catalog files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardlight import domain
from wardlight.sources.json_arrays import read_elements

_BAD = "_corrupt"


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, large: bool = False) -> DataFrame:
    """Rows of ``schema`` and, in ``_corrupt``, the text of what could not be read.

    A ``large`` array is read by many tasks.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path).withColumn(_BAD, F.lit(None).cast("string"))
    loose = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    if fmt == "json-array" and large:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
        parsed = F.from_json("element", loose, options).alias("r")
        return read_elements(spark, path).select(parsed).select("r.*")
    # A small array is read as a whole; JSON Lines files split and scale.
    return (
        spark.read.schema(loose)
        .option("multiLine", fmt == "json-array")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .json(path)
    )


def _with_reason(rows: DataFrame, needed: list[str]) -> DataFrame:
    """Add ``reason``: malformed, or the first needed column that is missing; null for good rows."""
    reason = F.when(F.col(_BAD).isNotNull(), "malformed")
    for name in needed:
        reason = reason.when(F.col(name).isNull(), name)
    return rows.withColumn("reason", reason)


def _sound(rows: DataFrame) -> DataFrame:
    """Good rows; the query fails at the first other one."""
    message = F.concat(F.lit("unreadable input: "), F.col("reason"))
    fine = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    return rows.filter(fine).drop("reason", _BAD)


# The engine's severities are numbers, not only whole ones.
_COMPLAINT = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == "severity" else f for f in domain.COMPLAINT])
_COMPLAINT_NEEDS = ["lat", "lng", "severity"]


def _complaint_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("id", "category", "districtId")})


def read_complaints(spark: SparkSession, path: str, fmt: str = "json-array") -> DataFrame:
    """Reports with defaults for missing text keys; severity is a double.

    ``fmt`` is ``json-array``, ``json-lines`` or ``parquet``.  The query fails on what
    cannot be read and on rows without lat, lng or severity; see :func:`split_complaints`.
    """
    return _complaint_defaults(_sound(_with_reason(_read(spark, path, _COMPLAINT, fmt, True), _COMPLAINT_NEEDS)))


def split_complaints(spark: SparkSession, path: str, fmt: str = "json-array") -> tuple[DataFrame, DataFrame]:
    """(reports, rejects): rejects have ``reason, record`` and the columns that could be read.

    A JSON array is read in as many splits as its file has; of one that breaks off, the
    rows before the break are good and what is left of the last one is a reject.
    """
    rows = _with_reason(_read(spark, path, _COMPLAINT, fmt, True), _COMPLAINT_NEEDS)
    good = _complaint_defaults(rows.filter("reason IS NULL").drop("reason", _BAD))
    return good, rows.filter("reason IS NOT NULL").withColumnRenamed(_BAD, "record")


def read_districts(spark: SparkSession, path: str, fmt: str = "json-array") -> DataFrame:
    """Districts with defaults: empty id and name, infraScore 1; the query fails on rows without lat or lng."""
    rows = _sound(_with_reason(_read(spark, path, domain.DISTRICT, fmt), ["lat", "lng"]))
    return rows.withColumns(
        {
            "id": F.coalesce("id", F.lit("")),
            "name": F.coalesce("name", F.lit("")),
            "infraScore": F.coalesce("infraScore", F.lit(1.0)),
        }
    )


def read_admin_catalog(spark: SparkSession, path: str, fmt: str = "json-array") -> DataFrame:
    """Nested catalog of states with their districts; see ``flatten_admin_catalog``."""
    return _sound(_with_reason(_read(spark, path, domain.ADMIN_CATALOG, fmt), []))
