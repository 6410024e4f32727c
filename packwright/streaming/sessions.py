"""Streams of session events: first sightings, and a token bucket for each user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMITED = "user_id long, event_id long, allowed boolean"


def dedup_stream(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(keys)


def spend(rows: pd.DataFrame, tokens: float, last: float, rate: float, size: float) -> tuple[list[bool], float, float]:
    """Whether each row (in order of ts, event_id) finds a token in a bucket of `size` that fills at `rate` a second."""
    allowed = []
    for t in rows["ts"].astype("int64") / 1e9 if len(rows) else []:
        tokens = min(size, tokens + max(0.0, t - last) * rate)
        last = max(t, last)
        allowed.append(tokens >= 1)
        tokens -= allowed[-1]
    return allowed, tokens, last


def rate_limit_stream(events: DataFrame, rate: float = 1 / 3600, size: float = 5) -> DataFrame:
    """user_id, event_id, allowed. The state of a user is two numbers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (size, 0.0)
        for b in batches:
            b = b.sort_values(["ts", "event_id"])
            allowed, tokens, last = spend(b, tokens, last, rate, size)
            yield pd.DataFrame({"user_id": b["user_id"], "event_id": b["event_id"], "allowed": allowed})
        state.update((tokens, last))

    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id").applyInPandasWithState(step, LIMITED, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def rate_limit(events: DataFrame, rate: float = 1 / 3600, size: float = 5) -> DataFrame:
    """The same over a finished table: rows of a user arrive in order of time and are met one batch after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, tokens, last = None, size, 0.0
        for b in batches:
            for key, part in b.groupby("user_id", sort=False):
                if key != user:
                    user, tokens, last = key, size, 0.0
                allowed, tokens, last = spend(part, tokens, last, rate, size)
                yield pd.DataFrame({"user_id": part["user_id"], "event_id": part["event_id"], "allowed": allowed})

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, LIMITED)
