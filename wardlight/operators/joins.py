"""Joins that check sizes before they broadcast and split hot keys beyond that."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A table with at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000
#: A key held by more rows than this is hot.  N rows hold fewer than N / HOT_ROWS hot keys.
HOT_ROWS = 1_000_000
#: Ways in which the rows of one hot key are split.
HOT_SPLITS = 64


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy row work on a scan of fewer partitions than there are cores.

    For a table read directly from files; counting the partitions of a frame behind a
    shuffle would run the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup(
    left: DataFrame,
    dim: DataFrame,
    on: list[str] | str,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to a table with unique keys (``inner`` or ``left``).

    A small ``dim`` is broadcast.  A larger one is shuffled, except for the keys that
    are hot in ``left``: their few ``dim`` rows are broadcast, so no task receives the
    whole of a hot key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if is_small(dim, broadcast_rows):
        return left.join(F.broadcast(dim), keys, how)
    hot = left.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys)
    if not has_rows(hot):
        return left.join(dim, keys, how)
    hot = F.broadcast(hot)
    hot_dim = F.broadcast(dim.join(hot, keys, "left_semi"))
    hot_part = left.join(hot, keys, "left_semi").join(hot_dim, keys, how)
    cold_part = left.join(hot, keys, "left_anti").join(dim, keys, how)
    return cold_part.unionByName(hot_part)


def join_group_rows(
    requests: DataFrame,
    rows: DataFrame,
    keys: list[str],
    split_by: str,
    hot: DataFrame | None,
) -> DataFrame:
    """Pair each request with all ``rows`` of its key, splitting the rows of hot keys.

    ``hot`` holds the hot keys (or None).  Rows of a hot key are spread over
    ``HOT_SPLITS`` parts by ``split_by``, and its requests are copied to each part.
    """
    if hot is None:
        return requests.join(rows, keys)
    mark = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    parts = F.when(F.col("_hot"), F.lit(HOT_SPLITS)).otherwise(F.lit(1))
    asked = (
        requests.join(mark, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_hot")
    )
    held = (
        rows.join(mark, keys, "left")
        .withColumn("_part", F.pmod(F.xxhash64(split_by), parts.cast("long")).cast("int"))
        .drop("_hot")
    )
    return asked.join(held, keys + ["_part"]).drop("_part")
