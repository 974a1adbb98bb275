"""Bursts of a stream, against the rule for a list."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.plans.queries import QUERIES
from quarry.streaming import debounce

SECOND = 1_000_000
SCHEMA = "user long, event long, time timestamp"


@pytest.fixture
def rocksdb(spark):
    held = spark.conf.get(debounce.PROVIDER)
    debounce.use_rocksdb(spark)
    yield
    spark.conf.set(debounce.PROVIDER, held)


def streamed(spark, folder, batches, gap, delay="1 hour"):
    """What is given for batches of (user, event, microseconds), one start of the stream each, and a last event that ends all bursts."""
    end = max(t for b in batches for _, _, t in b) + 10 * 3600 * SECOND
    for batch in [*batches, [(-1, -1, end)]]:
        rows = spark.createDataFrame(batch, "user long, event long, t long").select("user", "event", F.timestamp_micros("t").alias("time"))
        rows.write.mode("append").parquet(f"{folder}/events")
        found = debounce.debounce(spark.readStream.schema(SCHEMA).parquet(f"{folder}/events"), "user", "event", "time", gap, delay)
        writer = found.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
        writer.start(f"{folder}/bursts", format="parquet", outputMode="append").awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(found.schema).parquet(f"{folder}/bursts").select("user", "event", F.unix_micros("events_until")).collect())


@pytest.mark.parametrize("gap", [60, 0])
def test_bursts_of_a_stream(spark, rocksdb, tmp_path, gap):
    rng, at = random.Random(gap), 1_700_000_000 * SECOND
    times = [at + rng.choice([rng.randrange(3600), 30 * rng.randrange(120)]) * SECOND + rng.choice([0, 0, 1]) for _ in range(600)]  # many at the gap's bound, or equal
    rows = [(rng.randrange(12), n, t) for n, t in enumerate(times)]
    users = defaultdict(list)
    for user, event, time in rows:
        users[user].append((time, time, event))
    want = sorted((u, event, last) for u, x in users.items() for _, last, event in debounce.joined(x, gap * SECOND))
    assert streamed(spark, tmp_path, [rows[:200], rows[200:400], rows[400:]], f"{gap} seconds") == want


def test_no_python_for_each_key_and_burst(spark):
    events = spark.readStream.format("rate").load().select("value", "timestamp", (F.col("value") % 9).alias("user"))
    plan = debounce.debounce(events, "user", "value", "timestamp", "2 hours", "1 day")._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "TransformWithState" not in plan


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["str2_debounced_events"](spark, str(tmp_path)).collect() == []
