"""Event streams: windows with late data, sessions, and a token bucket; each with a batch twin."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY, REFILL_PER_S = 3.0, 1 / 3600


def _watched(events: DataFrame, late: str | None) -> DataFrame:
    """A stream gets a watermark (which needs a time with a zone); a table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming and late else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """(start, end, event_type, n, total): tumbling or sliding counts and sums. On a stream, rows later than `late` are dropped by the watermark."""
    rows = _watched(events, late)
    out = rows.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than gap apart."""
    rows = _watched(events, late)
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def histogram(events: DataFrame, size: str, bounds: list[float], late: str | None = "1 hour") -> DataFrame:
    """(start, le, n): cumulative counts of values at most each bound, by tumbling window."""
    rows = _watched(events, late)
    counts = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    out = rows.groupBy(F.window("ts", size)).agg(*counts)
    pairs = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds))))
    return out.select(F.col("window.start").alias("start"), pairs.alias("p")).select("start", "p.*")


def admit(times: list[float], tokens: float, last: float | None, capacity: float, rate: float) -> tuple[list[bool], float, float | None]:
    """Which requests at sorted times a bucket lets through, and its state after them."""
    out = []
    for t in times:
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, t - last) * rate)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


LIMITED = "user_id long, event_id long, admitted boolean"


def rate_limited(events: DataFrame, capacity: float = CAPACITY, rate: float = REFILL_PER_S) -> DataFrame:
    """(user_id, event_id, admitted) of a stream: a token bucket for each user, kept as state of two numbers.

    State goes once a user has been idle for as long as an empty bucket takes to fill: a full one is as good as none.
    """
    idle_ms = max(1000, math.ceil(capacity / rate * 1000))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, tokens, last = admit([t.timestamp() for t in rows["ts"]], tokens, last, capacity, rate)
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "admitted": out})

    return events.groupBy("user_id").applyInPandasWithState(step, LIMITED, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rate_limited_batch(events: DataFrame, capacity: float = CAPACITY, rate: float = REFILL_PER_S) -> DataFrame:
    """The same over a table. Users' rows stream in time order through sorted partitions, so a busy user is never gathered."""
    rows = events.select("user_id", "event_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, tokens, last = None, capacity, None
        for batch in batches:
            users, times = batch["user_id"].to_numpy(), batch["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6
            cuts = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
            flags = []
            for a, b in zip(cuts, cuts[1:], strict=False):  # a user's run at a time
                if a < b and users[a] != user:
                    user, tokens, last = users[a], capacity, None
                got, tokens, last = admit(times[a:b].tolist(), tokens, last, capacity, rate)
                flags += got
            yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "admitted": flags})

    return rows.mapInPandas(run, LIMITED)


def busiest(events: DataFrame, size: str, top: int = 3) -> DataFrame:
    """(start, event_type, n, rank): the commonest event types of each window."""
    counts = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("start").orderBy(F.col("n").desc(), "event_type"))).filter(F.col("rank") <= top)
