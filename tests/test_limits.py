"""Token buckets with a bound on clients: stream, table and a plain limiter agree, and state stays within the bound."""

import random
from collections import OrderedDict, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from kerbline.streaming import limits

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, user_id long, ts timestamp"


def made(seed, n=900, clients=60):
    r = random.Random(seed)
    at, rows = START, []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 1, 5, 40]))
        rows.append((i, r.choice([1, 2, 3, r.randrange(clients)]), at))
    return rows


def plain(rows, shard_of, most, capacity, rate):
    """The limiter as it is defined: an ordered dictionary for each shard."""
    shards, out = defaultdict(OrderedDict), {}
    for event, client, at in sorted(rows, key=lambda r: (r[2], r[0])):
        own, now = shards[shard_of[client]], at.timestamp()
        tokens, counted = own.pop(client, (capacity, now))
        tokens = min(capacity, tokens + (now - counted) * rate)
        out[event] = tokens >= 1
        own[client] = (tokens - out[event], now)
        while len(own) > most:
            own.popitem(last=False)
    return out


@pytest.mark.parametrize(("bound", "shards"), [(4, 1), (12, 3), (1000, 3)])
def test_table(spark, bound, shards):
    rows = made(bound)
    df = spark.createDataFrame(rows, SCHEMA)
    shard_of = {r.user_id: r.s for r in df.select("user_id", limits.shard_of(F.col("user_id"), shards).alias("s")).distinct().collect()}
    got = {r.event_id: r.admitted for r in limits.bounded_rate_limited_batch(df.repartition(4), 2.0, 0.02, bound, shards).collect()}
    assert got == plain(rows, shard_of, max(1, bound // shards), 2.0, 0.02)
    assert 0 < sum(got.values()) < len(got)


def test_the_bound_forgets_the_longest_unused():
    own = limits.Buckets(OrderedDict(), 2, 1.0, 0.001)
    assert [own.acquire(c, t) for t, c in enumerate([1, 2, 1, 3, 2, 1])] == [True, True, False, True, True, True]
    assert list(own.known) == [2, 1]


def test_stream_equals_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timeouts keep an availableNow query running
    try:
        stream_equals_table(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def stream_equals_table(spark, tmp_path):
    rows = made(7, 240, 40)
    for n in range(3):
        spark.createDataFrame(rows[n * 80 : (n + 1) * 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limited = limits.bounded_rate_limited(stream, 2.0, 0.02, 8, 2)
    query = limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) == 3
    got = {r.event_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = limits.bounded_rate_limited_batch(spark.createDataFrame(rows, SCHEMA), 2.0, 0.02, 8, 2)
    assert got == {r.event_id: r.admitted for r in table.collect()}
    state = spark.read.format("statestore").load(str(tmp_path / "state")).select(F.size("value.groupState.clients").alias("n")).collect()
    assert 1 <= len(state) <= 2 and all(r.n <= 4 for r in state)  # however many clients came
