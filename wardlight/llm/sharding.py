"""Reproducible global shuffle into shards by a Feistel permutation of row numbers.

Row ``i`` of ``n`` (in the order of the key) goes to place ``p = permute(i)``, then to
shard ``p % shards`` and slot ``p // shards``.  The permutation works on a grid of
``a x b >= n`` cells; the fewer than ``a`` cells beyond ``n`` are left by walking the
cycle, so nothing is stored and any place can be computed, forwards or back.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardlight.llm.tables import number
from wardlight.workspace import Workspace

#: Modulus of the round function, a prime under 2**31, so that squares fit a long.
PRIME = 2_147_483_647
ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 … n-1."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        if self.a >= PRIME:
            raise ValueError("more rows than the round function can tell apart")
        rng = np.random.Generator(np.random.PCG64(seed))
        self.keys = rng.integers(1, PRIME, (ROUNDS, 2)).tolist()

    def _mixed(self, half: np.ndarray, k: int) -> np.ndarray:
        first, second = self.keys[k]
        y = (half + first) % PRIME
        y = (y * y + second) % PRIME
        return (y * y + half) % PRIME

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2 == 0:
                left = (left + sign * self._mixed(right, k)) % self.a
            else:
                right = (right + sign * self._mixed(left, k)) % self.b
        return left * self.b + right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._step(np.asarray(x, np.int64), back)
        while (out := x >= self.n).any():
            x[out] = self._step(x[out], back)
        return x

    def permute(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def restore(self, places: np.ndarray) -> np.ndarray:
        """The row numbers that went to these places."""
        return self._walk(places, True)


def assign_shards(
    df: DataFrame, key: list[str], shards: int = 16, seed: int = 1, workspace: Workspace | None = None
) -> DataFrame:
    """Add ``row``, ``shard`` and ``slot`` (long, int, long) to every row of ``df``.

    Shard sizes differ by one at most and slots have no gaps.  Rows are numbered in the
    order of ``key`` (nulls first), so the same table and seed always give the same
    shuffle.  Rows with equal keys are told apart arbitrarily: give enough columns to
    make equal rows interchangeable.  Pass narrow columns; texts need not move.
    An empty table gives an empty result.  Columns called ``row``, ``shard`` or ``slot``
    are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    ws = workspace or Workspace(df.sparkSession)
    df = df.drop("row", "shard", "slot")
    rows = ws.write(number(df, [F.col(c) for c in key], "row", ws), "rows")
    permutation = Permutation(rows.count(), seed)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.permute(row.to_numpy()))

    return (
        rows.withColumn("_place", place("row"))
        .withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("_place")
    )


def row_at(shard: int, slot: int, n: int, shards: int = 16, seed: int = 1) -> int:
    """The number of the row that lies in this slot of this shard."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < n):
        raise IndexError("no such slot")
    return int(Permutation(n, seed).restore(np.array([place]))[0])


def sharded_documents(documents: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """Every document's shard and slot under the law ``rows``.

    Null texts count as empty (size 1, checksum 0).  Equal texts are separate rows and
    may lie in different shards.  Repeated rows get slots of their own.
    """
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = assign_shards(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
