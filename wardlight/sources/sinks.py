"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_BATCH = 500


def write_batched(df: DataFrame, path: str, batch: int = MAX_BATCH, fmt: str = "parquet") -> None:
    """Write files of at most ``batch`` records each."""
    df.write.format(fmt).option("maxRecordsPerFile", batch).save(path)


def hotspots_json(ranked: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows ``kind, json``: one JSON object per ranked district and cluster."""
    district = F.to_json(F.struct(*ranked.columns))
    flat = [c for c in clusters.columns if c not in ("lat", "lng")]
    cluster = F.to_json(F.struct(*flat, F.struct("lat", "lng").alias("centroid")))
    return ranked.select(F.lit("hotspot").alias("kind"), district.alias("json")).unionByName(
        clusters.select(F.lit("cluster").alias("kind"), cluster.alias("json"))
    )


def stats_json(stats_rows: DataFrame) -> DataFrame:
    """The long-form statistics as one JSON object; its size is bounded by the vocabularies and countries."""

    def entries(dimension: str):
        pairs = F.collect_list(F.when(F.col("dimension") == dimension, F.struct("key", "n")))
        return F.map_from_entries(F.array_sort(pairs))

    def single(dimension: str):
        return F.max(F.when(F.col("dimension") == dimension, F.col("n")))

    return stats_rows.agg(
        single("total").alias("totalComplaints"), entries("language").alias("languages"),
        entries("category").alias("categories"), entries("country").alias("countries"),
        single("districts").alias("districtsCovered"),
    ).select(F.to_json(F.struct("*")).alias("json"))
