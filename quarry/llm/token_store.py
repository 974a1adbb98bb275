"""Token ids as ORC files in document order.

ORC stores the ids as run-length encoded integers in stripes. Row indexes (every
ROW_INDEX rows) and a Bloom filter on the document id let a reader skip whole
stripes and row groups; separate stripes are read in parallel.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, scratch, slices, text_of
from quarry.llm.wordtok import encoder

SCHEMA = "part int, doc_id long, part_start long, n_tokens int, ids array<int>"
STRIPE_BYTES = 64 << 20
ROW_INDEX = 1000


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", mode: str = "errorifexists"
) -> None:
    """Encode every whole text, append ``end_id`` and write ORC in ascending order.

    The order is global: rows are range-partitioned and sorted by id (rows with
    the same id by their text), and each file holds one range. With each row goes
    its first position within its range, so that a reader finds any row's place in
    the whole corpus from the totals of the ranges alone. Null text is empty: it
    has only the end id. An empty table gives an empty ORC table.
    """
    tie = F.xxhash64("text")
    source = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        .withColumn("tie", tie)
        .withColumn("copy", F.monotonically_increasing_id())  # repeated rows need not share a range
        .repartitionByRange("doc_id", "tie", "copy")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    arrow = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        part, start, end = TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        for batch in batches:
            for some in slices(batch, 500):
                ids = encoder(tokenizer).batch(some.column(1).to_pylist())
                n = np.array([len(i) + 1 for i in ids], np.int64)
                flat = np.concatenate([x for i in ids for x in (i, end)]).astype(np.int32)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), some.column(0), pa.array(start + ends - n), pa.array(n.astype(np.int32)), lists], schema=arrow
                )
                start += int(ends[-1])

    (
        source.mapInArrow(run, SCHEMA)
        .write.mode(mode)
        .option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    ``doc_ids`` or a range ``low <= doc_id <= high`` is pushed down to the ORC
    statistics and Bloom filters, so that only stripes and row groups that may
    hold those documents are read. Starts come from per-file totals.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file of the table
    base = totals.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(doc_ids)))
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""

    def rows(batch: pa.RecordBatch) -> dict:
        lists = batch.column(3)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        return {
            "part": batch.column(0), "doc_id": batch.column(1), "part_start": batch.column(2), "n_tokens": np.diff(offsets).astype(np.int64),
            "ids_crc32": np.array([crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64),
        }

    table = spark.read.schema(SCHEMA).orc(path)
    arrow = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    own = arrow_map(table.select("part", "doc_id", "part_start", "ids"), "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long", rows, arrow)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return own.join(base, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a scratch folder, then :func:`digests` of what was written."""
    path = scratch(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id, id_col, text_col)
    return digests(docs.sparkSession, path)
