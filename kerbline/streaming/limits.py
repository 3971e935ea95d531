"""A token bucket for each client with a bound on how many clients are remembered, as a stream and over a table."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import CAPACITY, REFILL_PER_S, admit

MAX_CLIENTS, SHARDS = 100_000, 64
OUT = "user_id long, event_id long, admitted boolean"


def shard_of(client: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(client), F.lit(shards)).cast("int")


def _sharded(events: DataFrame, shards: int) -> DataFrame:
    rows = events.select(F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.withColumn("shard", shard_of(F.col("user_id"), shards))


def share(max_clients: int, shards: int) -> int:
    """Clients that a shard remembers."""
    return max(1, max_clients // shards)


class Buckets:
    """Buckets of a shard in the order of their last use; beyond `most` the one used longest ago is forgotten, and is as good as full then."""

    def __init__(self, known: OrderedDict, most: int, capacity: float, rate: float):
        self.known, self.most, self.capacity, self.rate = known, most, capacity, rate

    def acquire(self, client: int, at: float) -> bool:
        tokens, last = self.known.pop(client, (self.capacity, None))
        (admitted,), tokens, last = admit([at], tokens, last, self.capacity, self.rate)
        self.known[client] = (tokens, last)
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return admitted


def bounded_rate_limited(events: DataFrame, capacity: float = CAPACITY, rate: float = REFILL_PER_S, max_clients: int = MAX_CLIENTS, shards: int = SHARDS) -> DataFrame:
    """(user_id, event_id, admitted) of a stream (user_id, event_id, ts): a bucket for each client, of which max_clients at most are kept.

    Clients are dealt to shards by hash; a shard's state is its buckets in the order of their last use. It keeps its share of the bound
    and forgets the client used longest ago, so state never grows beyond it, however many clients come. A shard that has been idle for as
    long as an empty bucket takes to fill is cleared by a timeout. Rows of a micro-batch are taken in time order, ties by event_id; rows
    without a client are one client, 0.
    """
    most, idle_ms = share(max_clients, shards), max(1000, math.ceil(capacity / rate * 1000))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clients, tokens, last = state.get if state.exists else ([], [], [])
        own = Buckets(OrderedDict(zip(map(int, clients), zip(tokens, last, strict=True), strict=True)), most, capacity, rate)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # a shard's rows of one micro-batch
        out = [own.acquire(client, at.timestamp()) for client, at in zip(rows["user_id"].tolist(), rows["ts"], strict=True)]
        state.update((list(own.known), [t for t, _ in own.known.values()], [at for _, at in own.known.values()]))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "admitted": out})

    sharded = _sharded(events, shards)
    return sharded.groupBy("shard").applyInPandasWithState(step, OUT, "clients array<long>, tokens array<double>, last array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def bounded_rate_limited_batch(events: DataFrame, capacity: float = CAPACITY, rate: float = REFILL_PER_S, max_clients: int = MAX_CLIENTS, shards: int = SHARDS) -> DataFrame:
    """The same over a table: shards' rows stream in time order through sorted partitions, and only buckets are held."""
    most = share(max_clients, shards)
    ordered = _sharded(events, shards).repartition("shard").sortWithinPartitions("shard", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, own = None, Buckets(OrderedDict(), most, capacity, rate)
        for batch in batches:
            out = []
            times = batch["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6
            for s, client, at in zip(batch["shard"].tolist(), batch["user_id"].tolist(), times.tolist(), strict=True):
                if s != shard:
                    shard, own = s, Buckets(OrderedDict(), most, capacity, rate)
                out.append(own.acquire(client, at))
            yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "admitted": out})

    return ordered.mapInPandas(run, OUT)
