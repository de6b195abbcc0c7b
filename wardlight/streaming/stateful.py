"""Keyed streaming state: the bucket of each sender.

The rows of one key are ordered inside each micro-batch; the source's rate limit
(``maxFilesPerTrigger`` and the like) bounds what a key can bring at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlight.operators.rate_limit import CAPACITY, REFILL_PER_S, flag_run, units
from wardlight.shipping import ship_package

#: How far the watermark stays behind the newest event.
LATENESS = "1 hour"


def stream_token_bucket(
    events: DataFrame, key: str, time: str, tie: str, capacity: float = CAPACITY, refill_per_s: float = REFILL_PER_S,
    lateness: str = LATENESS,
) -> DataFrame:
    """Flag arriving events (append mode).

    The state of a key is two numbers.  It is dropped by an event-time timer once the
    watermark, ``lateness`` behind the newest event, has passed the moment at which the
    bucket is full again: from then on a missing state says the same, so nothing is lost
    however long the stream pauses.  An event that is older than its key's state finds no
    refill; Spark drops events that are older than the watermark, so ``lateness`` must
    cover the disorder of the source.
    """
    ship_package(events.sparkSession)
    scale = units(capacity, refill_per_s)
    watched = events.select(F.col(key).alias("k"), F.col(time).alias("at"), F.col(tie).alias("tie")).withWatermark("at", lateness)
    slim = watched.select("k", F.unix_micros("at").alias("us"), "tie", "at")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def flag(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["us", "tie"])
        times = rows["us"].tolist()
        tokens, last = state.get if state.exists else (scale[2], times[0])
        flags, tokens = flag_run(times, tokens, last, scale)
        last = max(last, times[-1])
        state.update((tokens, last))
        if scale[1]:
            full_us = last - (tokens - scale[2]) // scale[1]  # rounded up
            state.setTimeoutTimestamp(max(full_us // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[["k", "us", "tie"]].assign(allowed=flags)

    return slim.groupBy("k").applyInPandasWithState(
        flag, f"k {kinds['k']}, us long, tie {kinds['tie']}, allowed boolean", "tokens long, last long", "append",
        GroupStateTimeout.EventTimeTimeout,
    ).select(F.col("k").alias(key), F.timestamp_micros("us").alias(time), F.col("tie").alias(tie), "allowed")
