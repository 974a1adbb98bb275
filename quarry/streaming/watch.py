"""Continuous indexing.

A stream over a tree delivers what was inserted, changed and deleted since the last
batch (``sources.tree``), and each batch becomes one commit of the store. A cycle that
compares the listing with the store does the same without a stream.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunkers import Chunkers
from quarry.sources import tree
from quarry.sources.indexer import Synced, apply_changes, write_bodies
from quarry.sources.store import Store

#: How long a burst of events is gathered.
DEBOUNCE = "300 milliseconds"


def apply_batch(store: Store, batch: DataFrame, line_ranges: bool = True, number: tuple[str, int] | None = None) -> Synced:
    """Index one micro-batch of bodies (path, mtime, length, body); of several events for a path the latest counts.

    Running a batch again gives the same store, as rows are replaced by key; a
    batch with a ``number`` (stream, batch) that the store has already is left alone.
    """
    if number and store.applied(number[0]) >= number[1]:
        return Synced(0, 0)
    one = batch.groupBy("path").agg(F.max_by(F.struct("mtime", "length", "body"), "mtime").alias("e")).select("path", "e.*")
    return write_bodies(store, one, line_ranges, number)


def index_stream(
    spark: SparkSession, store: Store, root: str, checkpoint: str, once: bool = False, on_batch: Callable[[int, Synced], None] | None = None,
    line_ranges: bool = True, chunkers: Chunkers | None = None,
):
    """Start following a tree; with ``once`` up to what is there now.

    Insertions, changes and deletions of a batch are one commit, which carries the
    batch's number: a batch that is run again after a restart changes nothing more.
    ``checkpoint`` is a folder that the executors reach by its path, since the
    listing of the last batch is kept beside it.
    """
    stream = checkpoint.rstrip("/")

    def run(batch: DataFrame, number: int) -> None:
        done = apply_changes(store, batch, line_ranges, chunkers, (stream, number))
        if on_batch:
            on_batch(number, done)

    events = tree.changes(spark, root, tree.local(f"{stream}-listed"))
    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def watch_tree(workspace, interval: float = 60, cycles: int | None = None, log: Callable[[str], None] = print) -> None:
    """Compare listing and store every ``interval`` seconds; an error is logged and the loop goes on."""
    n = 0
    while cycles is None or n < cycles:
        if n:
            time.sleep(interval)
        n += 1
        try:
            written, removed = workspace.refresh()
            if written or removed:
                log(f"{written} indexed, {removed} removed")
        except Exception as e:  # noqa: BLE001 - one bad cycle must not end the watch
            log(f"refresh failed: {e}")
