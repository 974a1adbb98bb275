"""Keyed changes: what a sync inserts, updates, keeps and deletes. All are joins on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same key."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new.select(*old.columns))


def remove(old: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*key), list(key), "left_anti")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of each parent in ``new`` are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


ACTIONS = ("insert", "update_text", "update_range", "keep", "delete")


def _action(was: Column, now: Column, same_text: Column, same_end: Column) -> Column:
    return F.when(was.isNull(), "insert").when(now.isNull(), "delete").when(~same_text, "update_text").when(~same_end, "update_range").otherwise("keep")


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, line_start, action (insert, update_text, update_range, keep, delete).

    A changed text loses its vector; a kept one keeps it.
    """
    o = old.select("doc_id", "line_start", F.col("text").alias("old_text"), F.col("line_end").alias("old_end"), F.lit(True).alias("was"))
    n = new.select("doc_id", "line_start", F.col("text").alias("new_text"), F.col("line_end").alias("new_end"), F.lit(True).alias("is"))
    action = _action(F.col("was"), F.col("is"), F.col("old_text") == F.col("new_text"), F.col("old_end") == F.col("new_end"))
    return o.join(n, ["doc_id", "line_start"], "full").select("doc_id", "line_start", action.alias("action"))


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector of their present text (a missing text is equal to itself)."""
    own = chunks.withColumn("text_hash", F.sha2("text", 256))
    held = vectors.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "line_start", "text_hash")))
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.col("line_start") == F.col("_line_start")) & F.col("text_hash").eqNullSafe(F.col("_text_hash"))
    return own.join(held, same, "left_anti")


def chunk_states(old: DataFrame, new: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, line_start, text_hash, action, embedded of the old and the new chunks of some documents.

    ``embedded`` says that a vector of the new text is there. Keys and hashes alone
    are shuffled, and nothing after the joins is, so a count of the actions that is
    taken while the result is written holds whatever tasks run twice.
    """
    o = old.select("doc_id", "line_start", F.sha2("text", 256).alias("was"), F.col("line_end").alias("old_end"))
    n = new.select("doc_id", "line_start", F.sha2("text", 256).alias("text_hash"), "line_end")
    v = vectors.groupBy("doc_id", "line_start").agg(F.collect_set("text_hash").alias("held"))
    action = _action(F.col("was"), F.col("text_hash"), F.col("was") == F.col("text_hash"), F.col("old_end") == F.col("line_end"))
    known = F.coalesce(F.array_contains("held", F.col("text_hash")), F.lit(False))
    both = o.join(n, ["doc_id", "line_start"], "full").join(v, ["doc_id", "line_start"], "left")
    return both.select("doc_id", "line_start", "text_hash", action.alias("action"), known.alias("embedded"))


def embedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keys of the chunks that have a vector."""
    return chunks.select("doc_id", "line_start").join(vectors.select("doc_id", "line_start"), ["doc_id", "line_start"], "left_semi")


def changed_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that are new or differ in time or length from what is stored."""
    known = files.select("path", F.col("mtime").alias("old_mtime"), F.col("length").alias("old_length"))
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("length").eqNullSafe(F.col("old_length"))
    return listing.join(known, "path", "left").filter(~same).drop("old_mtime", "old_length")


def newest(records: DataFrame, incoming: DataFrame, key: str, time: str) -> DataFrame:
    """Last writer wins per key; what is there already wins ties; null is the oldest time."""
    both = records.withColumn("_source", F.lit(0)).unionByName(incoming.select(*records.columns).withColumn("_source", F.lit(1)))
    order = W.partitionBy(key).orderBy(F.desc_nulls_last(time), "_source")
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_source")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` does not have."""
    return a.select(key).join(b.select(key), key, "left_anti")


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits or vectors (by doc_id) with their documents' columns (by id); those of unknown documents are left out."""
    return hits.join(documents.withColumnRenamed("id", "doc_id"), "doc_id")
