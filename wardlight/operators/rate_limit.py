"""Token-bucket flags over an event log, exact and without collecting a whole key.

Events are cut into chunks of bounded size in (key, time) order.  For a key that spans
several chunks, each of its chunks first yields the map from the tokens before it to
the tokens after it; chaining these short maps gives every chunk its starting state,
after which all chunks are flagged independently.  Tokens are counted in integer units,
so the chained states equal those of one long pass.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardlight.operators import joins
from wardlight.shipping import ship_package
from wardlight.workspace import Workspace

CAPACITY = 20.0
REFILL_PER_S = 0.5
CHUNK_ROWS = 200_000


def units(capacity: float, refill_per_s: float) -> tuple[int, int, int]:
    """(units per token, units refilled per microsecond, units of a full bucket)."""
    # The shortest decimal of a float is what its writer meant; it is taken exactly.
    rate = Fraction(repr(float(refill_per_s))) / 1_000_000
    full = Fraction(repr(float(capacity))) * rate.denominator
    scale = full.denominator
    out = rate.denominator * scale, rate.numerator * scale, int(full * scale)
    if rate < 0 or capacity < 0 or max(out) >= 2**62:
        raise ValueError("capacity and rate must be positive and of fewer digits")
    return out


def flag_run(times: list[int], tokens: int, last: int, scale: tuple[int, int, int]) -> tuple[list[bool], int]:
    """Flags of one key's time-ordered events from a state, and the tokens left."""
    token, per_us, full = scale
    flags = []
    for t in times:
        tokens = min(full, tokens + max(0, t - last) * per_us)
        last = max(last, t)
        allowed = tokens >= token
        if allowed:
            tokens -= token
        flags.append(allowed)
    return flags, tokens


def _pieces(times: list[int], scale: tuple[int, int, int]) -> list[list[int]]:
    """The map from tokens at the first event (already refilled) to tokens after the last.

    A piece [low, high, slope, offset] sends x to slope * x + offset; slope is 0 or 1.
    """
    token, per_us, full = scale
    pieces = [[0, full, 1, 0]]
    last = times[0]
    for t in times:
        gain, last = (t - last) * per_us, t
        after: list[list[int]] = []
        for low, high, slope, offset in pieces:
            offset += gain
            parts = [(low, high, slope, offset)]
            if slope == 0:
                parts = [(low, high, 0, min(full, offset))]
            elif high + offset > full:
                edge = full - offset
                parts = [(low, min(high, edge), 1, offset), (max(low, edge + 1), high, 0, full)]
            for lo, hi, s, o in parts:
                if lo > hi:
                    continue
                if s == 0:
                    _add(after, lo, hi, 0, o - token if o >= token else o)
                    continue
                edge = token - o
                _add(after, lo, min(hi, edge - 1), 1, o)
                _add(after, max(lo, edge), hi, 1, o - token)
        pieces = after
    return pieces


def _add(pieces: list[list[int]], low: int, high: int, slope: int, offset: int) -> None:
    if low > high:
        return
    if pieces and pieces[-1][2:] == [slope, offset] and pieces[-1][1] + 1 == low:
        pieces[-1][1] = high
    else:
        pieces.append([low, high, slope, offset])


def token_bucket(
    events: DataFrame, key: str, time: str, tie: str, capacity: float = CAPACITY,
    refill_per_s: float = REFILL_PER_S, chunk_rows: int = CHUNK_ROWS, workspace: Workspace | None = None,
) -> DataFrame:
    """Add ``allowed`` to ``key, time, tie`` rows: buckets start full and each event takes a token.

    Events of a key are taken in the order of ``time`` and ``tie``.
    """
    ship_package(events.sparkSession)
    ws = workspace or Workspace(events.sparkSession)
    scale = units(capacity, refill_per_s)
    slim = events.select(F.col(key).alias("k"), F.unix_micros(time).alias("us"), F.col(tie).alias("tie"), F.col(time).alias("time"))
    chunks = max(1, math.ceil(events.count() / chunk_rows))
    cut = ws.write(
        slim.repartitionByRange(chunks, "k", "us", "tie").withColumn("chunk", F.spark_partition_id()), "chunks"
    )
    starts = _starts(cut, scale)
    rows = cut.join(F.broadcast(starts), ["k", "chunk"], "left")

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "us", "tie"])
        flags: list[bool] = []
        for _, run in pdf.groupby("k", sort=False, dropna=False):
            first = run.iloc[0]
            known = not pd.isna(first["tokens"])
            state = (int(first["tokens"]), int(first["last"])) if known else (scale[2], int(first["us"]))
            flags += flag_run(run["us"].tolist(), *state, scale)[0]
        return pdf[["k", "time", "tie"]].assign(allowed=flags)

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    out = rows.groupBy("chunk").applyInPandas(
        flag, f"k {kinds['k']}, time {kinds['time']}, tie {kinds['tie']}, allowed boolean"
    )
    return out.select(F.col("k").alias(key), F.col("time").alias(time), F.col("tie").alias(tie), "allowed")


def _starts(cut: DataFrame, scale: tuple[int, int, int]) -> DataFrame:
    """``k, chunk, tokens, last``: the state before each chunk of a key that spans chunks.

    At most two keys per chunk can span, so this table is bounded by the chunk count.
    """
    kind = cut.schema["k"].dataType.simpleString()
    spanning = cut.groupBy("k").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a < b").select("k")
    shape = f"k {kind}, chunk int, tokens long, last long"
    if not joins.has_rows(spanning):
        return cut.sparkSession.createDataFrame([], shape)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf.sort_values(["us", "tie"])["us"].tolist()
        return pd.DataFrame(
            {"k": [pdf["k"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "first": [times[0]], "last": [times[-1]],
             "pieces": [json.dumps(_pieces(times, scale))]}
        )

    maps = cut.join(F.broadcast(spanning), "k", "left_semi").groupBy("k", "chunk").applyInPandas(
        summarise, f"k {kind}, chunk int, first long, last long, pieces string"
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        tokens, last = scale[2], int(pdf["first"].iloc[0])
        states = []
        for row in pdf.itertuples():
            states.append((tokens, last))
            x = min(scale[2], tokens + (row.first - last) * scale[1])
            slope, offset = next((s, o) for lo, hi, s, o in json.loads(row.pieces) if lo <= x <= hi)
            tokens, last = slope * x + offset, row.last
        return pdf[["k", "chunk"]].assign(tokens=[s[0] for s in states], last=[s[1] for s in states])

    return maps.groupBy("k").applyInPandas(chain, shape)
