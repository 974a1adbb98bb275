"""Bring a store up to date with a directory tree."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import fnv1a64
from quarry.operators import changes, chunk
from quarry.operators.chunkers import Chunkers, chunk_with
from quarry.sources import files
from quarry.sources.store import Store

#: Of the files that executors could not read, so many are tried on the driver.
UNREAD_TRIED = 20
#: Bytes of files that are read, and later chunked, by one task.
PART_BYTES = 16 << 20


def documents_of(bodies: DataFrame) -> DataFrame:
    """The files with their ``id``, a hash of the path."""
    return bodies.withColumn("id", fnv1a64(F.col("path")))


class Synced(tuple):
    """(documents written, documents removed), and ``actions``: how many chunks were inserted, updated, kept and deleted."""

    actions: Counter

    def __new__(cls, written: int, removed: int, actions: Counter | None = None) -> Synced:
        out = super().__new__(cls, (written, removed))
        out.actions = actions or Counter()
        return out


def chunks_of(documents: DataFrame, line_ranges: bool = True, chunkers: Chunkers | None = None) -> DataFrame:
    """Chunks of all documents, each by the chunker of its kind.

    Paragraphs carry their line range, or their ordinal without ``line_ranges``
    (a document without paragraphs then has no chunk). Extensions in ``chunkers``
    go through these; the others are chunked natively in the row.
    """
    path, plugged = F.col("path"), None
    if chunkers and chunkers.extensions():
        own = F.coalesce(chunkers.handles(path), F.lit(False))
        plugged, documents = chunk_with(documents.filter(own), chunkers), documents.filter(~own)
    jsonl = documents.filter(files.is_jsonl(path))
    text = documents.filter(~files.is_jsonl(path))
    out = chunk.chunk_jsonl(jsonl).unionByName(chunk.chunk_markdown(text) if line_ranges else chunk.chunk_paragraphs(text))
    return out.unionByName(plugged) if plugged else out


def _index(store: Store, listed: DataFrame, line_ranges: bool, chunkers: Chunkers | None = None, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Synced:
    """Read, chunk and write files, and remove documents, in one commit; each file is read and chunked once.

    Files that nobody can read are left out. One that the driver can read and an
    executor cannot means that the executors do not reach the tree: an error, as the
    index would silently lack it.
    """
    size = listed.agg(F.sum(F.greatest("length", F.lit(0)))).first()[0] or 0
    # folders differ in size, and so do the partitions of a listing
    held = store.stage(documents_of(files.read_all(listed.repartition(size // PART_BYTES + 1))))
    unread = [r["path"] for r in held.filter(F.col("content").isNull()).select("path").limit(UNREAD_TRIED).collect()]
    lost = [p for p in unread if os.access(p, os.R_OK)]
    if lost:
        store.clear_stage()
        raise OSError(f"executors cannot read {lost[0]}, which the driver can; do they reach the tree?")
    return _write(store, files.text_of(held), held, line_ranges, chunkers, removed, batch)


def write_bodies(store: Store, bodies: DataFrame, line_ranges: bool = True, batch: tuple[str, int] | None = None) -> Synced:
    """Write documents given as path, mtime, length, body."""
    held = store.stage(documents_of(bodies))
    return _write(store, held, held, line_ranges, batch=batch)


def _write(store: Store, held: DataFrame, staged: DataFrame, line_ranges: bool, chunkers: Chunkers | None = None, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Synced:
    """Write the documents in ``held``, which is made from ``staged``."""
    documents, actions = store.stage(held.select("id", "path", "mtime", "length")), Counter()  # without the texts
    n = documents.count()
    gone = removed.count() if removed is not None else 0
    if n:
        chunks = chunks_of(held, line_ranges, chunkers)
        actions = store.upsert_documents(documents.select("id", "path"), chunks, documents.select("path", "mtime", "length"), removed if gone else None, batch, staged)
    elif gone:
        store.remove_documents(removed, batch)
    store.clear_stage()
    return Synced(n, gone, actions)


def _vanished(store: Store, listed: DataFrame) -> DataFrame:
    return store.stage(store.documents().join(listed.select("path"), "path", "left_anti").select("id"))


def _sync(store: Store, listed: DataFrame, chosen: DataFrame, line_ranges: bool, chunkers: Chunkers | None) -> Synced:
    return _index(store, chosen, line_ranges, chunkers, _vanished(store, listed))


def sync(spark: SparkSession, store: Store, root: str, line_ranges: bool = True, chunkers: Chunkers | None = None) -> Synced:
    """Index every file below ``root`` and forget what is no longer there."""
    listed = store.stage(files.listing(spark, root, chunkers))
    return _sync(store, listed, listed, line_ranges, chunkers)


def sync_incremental(spark: SparkSession, store: Store, root: str, line_ranges: bool = True, chunkers: Chunkers | None = None) -> Synced:
    """The same for files whose time or length differs from what is stored."""
    listed = store.stage(files.listing(spark, root, chunkers))
    return _sync(store, listed, changes.changed_files(listed, store.files()), line_ranges, chunkers)


def apply_changes(store: Store, events: DataFrame, line_ranges: bool = True, chunkers: Chunkers | None = None, batch: tuple[str, int] | None = None) -> Synced:
    """Follow events (path, mtime, length, event) in one commit: files are read and indexed, deleted ones forgotten.

    A batch that the store has already is left alone. A file that vanished since it
    was listed is forgotten with the event that tells so.
    """
    if batch and store.applied(batch[0]) >= batch[1]:
        return Synced(0, 0)
    path = F.col("path")
    indexed = files.is_indexed(path) | chunkers.handles(path) if chunkers else files.is_indexed(path)
    held = store.stage(events.filter(indexed))
    gone = store.stage(held.filter("event = 'delete'").select(fnv1a64(path).alias("id")))
    return _index(store, held.filter("event <> 'delete'").select("path", "mtime", "length"), line_ranges, chunkers, gone, batch)


def update_file(spark: SparkSession, store: Store, root: str, path: str, line_ranges: bool = True, chunkers: Chunkers | None = None) -> bool:
    """Index one file again; False if its kind is not indexed."""
    found = files.resolve(root, path)
    info = found.stat()
    listed = spark.createDataFrame([(str(found), int(info.st_mtime), info.st_size)], "path string, mtime bigint, length bigint")
    kind = files.is_indexed(F.col("path"))
    return _index(store, listed.filter(kind | chunkers.handles(F.col("path")) if chunkers else kind), line_ranges, chunkers)[0] > 0


def delete_file(spark: SparkSession, store: Store, root: str, path: str) -> None:
    """Forget one file."""
    found = str(files.resolve(root, path))
    store.remove_documents(store.documents().filter(F.col("path") == found).select("id"))


def apply_event(spark: SparkSession, store: Store, root: str, path: str, line_ranges: bool = True, chunkers: Chunkers | None = None) -> bool:
    """Index a file that exists, forget one that does not; True if it is indexed now."""
    if files.resolve(root, path).is_file():
        return update_file(spark, store, root, path, line_ranges, chunkers)
    delete_file(spark, store, root, path)
    return False
