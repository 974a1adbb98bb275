"""Bursts of events, by event time: of each burst the last event is given, once it is over.

A burst is a run of events of one key with at most ``gap`` between neighbours: a session
window, of which the state keeps bounds and last event. It survives restarts with the
stream's checkpoint. A burst ends when the watermark has passed its last event by more
than ``gap``: no event can prolong it any more. Events may come in any order within the
watermark's delay, also in different batches; two open bursts that a late one bridges
become one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_Burst = tuple[int, int, int]  # first and last time in microseconds, the last event's number


def joined(bursts: list[_Burst], gap: int) -> list[_Burst]:
    """The rule for a list: bursts in order of time, those at most ``gap`` apart joined; of equal last times the larger number counts."""
    out: list[_Burst] = []
    for first, last, event in sorted(bursts):
        if out and first - out[-1][1] <= gap:
            last, event = max((last, event), out[-1][1:])
            out[-1] = (out[-1][0], last, event)
        else:
            out.append((first, last, event))
    return out


def debounce(events: DataFrame, key: str, event: str, time: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    """The last event of each burst: key, event, events_until.

    ``events`` is a stream with a numeric key, event number and timestamp; those
    without a key or a time are left out. ``gap`` and ``delay`` (of the watermark) are
    intervals; events that are later than ``delay`` may be left out or be bursts of their
    own. Open bursts are native state, best kept in RocksDB (:func:`use_rocksdb`), which
    need not hold them all in memory.
    """
    start = F.timestamp_seconds(F.lit(0))
    width = events.sparkSession.range(1).select(F.unix_micros(start + F.expr(f"INTERVAL {gap}"))).first()[0]
    rows = events.select(F.col(key).cast("long").alias(key), F.col(event).cast("long").alias("event"), F.col(time).cast("timestamp").alias("time"))
    rows = rows.filter(F.col(key).isNotNull() & F.col("time").isNotNull()).withWatermark("time", delay)
    burst = F.session_window("time", gap) if width else F.col("time")  # windows without a width would be left out
    last = rows.groupBy(key, burst).agg(F.max(F.struct("time", "event")).alias("last"))
    return last.select(key, F.col("last.event").alias(event), F.col("last.time").alias("events_until"))


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB; streams that run already keep theirs."""
    spark.conf.set(PROVIDER, ROCKSDB)
