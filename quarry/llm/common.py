"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key that holds more than this share of all rows is "hot". At most
#: 1 / HOT_SHARE keys can be hot, so a list of hot keys is always small.
HOT_SHARE = 1 / 1000
#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20
#: A set of keys is sent to the executors as at most so many bits (64 MB).
MAX_BITS = 1 << 29
#: Long columns of one row of such a bitmap.
_WORDS = 8
#: Facts that meet one copy of a dimension row in :func:`join_salted`.
SALT_ROWS = 1000

#: Rows and bytes of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_scratch: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the checkpoint folder that the whole cluster shares.

    The folder is the one in ``spark.checkpoint.dir``; only where that is unset
    (tests, notebooks) a temporary local one is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def delete_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders of this process."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _scratch.remove(path)


@contextmanager
def temporary_scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch folders that are made inside at the end.

    Results of operators read from them: save a result inside.
    """
    before = set(_scratch)
    try:
        yield
    finally:
        delete_scratch(spark, *[p for p in _scratch if p not in before])


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        delete_scratch(table.sparkSession, table._scratch_path)


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where ``df`` has such a column."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``most_bytes`` bytes of texts and lists of numbers (but of one row at least)."""
    most_bytes = most_bytes or SLICE_BYTES
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type) and pa.types.is_primitive(column.type.value_type):
            size += pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) * (column.type.value_type.bit_width // 8)
    ends, at, done = np.cumsum(size), 0, 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which are held twice: outside the JVM's heap and in the worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).rstrip("bB")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def arrow_map(
    df: DataFrame,
    schema: str,
    rows: Callable[[pa.RecordBatch], Iterable[dict]],
    arrow: pa.Schema,
    batch_rows: int = 2000,
) -> DataFrame:
    """``mapInArrow`` over slices that are bounded by rows and by bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch_rows):
                yield pa.RecordBatch.from_pydict(rows(part), schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, test: Callable[[list], list]) -> DataFrame:
    """The rows of ``df`` for whose text (null: empty) ``test`` of a list of texts says true.

    Whole rows go through Python in slices, so that no queue holds them in between.
    """
    small_batches(df.sparkSession)
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2000):
                kept = part.filter(pa.array(test([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return df.mapInArrow(run, df.schema)


def located(docs: DataFrame, from_files: bool) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns that say where a row is stored, and their names.

    The place is the same whenever the row is read, whatever the partitioning, so
    that decisions can be joined back to it. It is a file (87 bits of two hashes
    of its path) and the row's number there. ``from_files`` says that ``docs`` is a
    plain read of Parquet files; anything else is written to the scratch folder.
    """
    small_batches(docs.sparkSession)
    file, at = fresh(docs, "file", "at")

    def placed(table: DataFrame) -> DataFrame:
        meta = table.metadataColumn("_metadata")
        index = meta["row_index"].bitwiseOR(F.shiftleft(F.pmod(F.hash(meta["file_path"]), F.lit(1 << 23)).cast("long"), 40))
        return table.select("*", F.xxhash64(meta["file_path"]).alias(file), index.alias(at))

    if from_files:
        try:
            return placed(docs), file, at
        except AnalysisException:  # not a read of files
            pass
    return placed(materialise(docs, "rows")), file, at


def ranked(df: DataFrame, keys: Sequence[Column], rank: str) -> DataFrame:
    """``df`` in the order of ``keys``, written to the scratch folder, with each row's place in it as ``rank`` (from 0).

    Every task writes one range of the order as a file; a row's rank is its number
    there and the rows of the files before. The files' totals, one row for each
    task of the sort, are all that is broadcast. Equal keys share a range, so let
    the last key spread them.
    """
    part, file, start = fresh(df, "part", "file", "start")
    path = scratch(df.sparkSession, "ranked")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id()).write.parquet(path)
    table = df.sparkSession.read.schema(f"{df._jdf.schema().toDDL()}, {part} int").parquet(path)
    meta = table.metadataColumn("_metadata")
    rows = table.select("*", meta["file_path"].alias(file), meta["row_index"].alias(rank))
    ends = rows.groupBy(part, file).agg((F.max(rank) + 1).alias("n"))
    starts = ends.select(file, (F.sum("n").over(W.orderBy(part, file)) - F.col("n")).alias(start))
    out = rows.join(F.broadcast(starts), file).withColumn(rank, F.col(rank) + F.col(start)).drop(part, file, start)
    out._scratch_path = path
    return out


def among(df: DataFrame, on: Sequence[str], keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: true for each row whose key is in ``keys``, and for few others.

    The keys' hashes are broadcast as a bitmap of 32 bits a key, MAX_BITS at most, in
    rows of _WORDS long columns: with more keys than that the flag says less, and
    never anything wrong. A join for which it says yes shuffles little else than the
    rows that it keeps.
    """
    bits = 1 << max(15, min(MAX_BITS.bit_length() - 1, (32 * keys.count()).bit_length()))
    line, h, *words = fresh(df, "line", "h", *(f"word{i}" for i in range(_WORDS)))
    hashed = F.pmod(F.xxhash64(*on), F.lit(bits))
    width = 64 * _WORDS
    word = F.floor(F.col(h) % width / 64)
    bit = F.expr(f"shiftleft(1L, cast(`{h}` % 64 as int))")
    maps = keys.select(hashed.alias(h)).groupBy(F.floor(F.col(h) / width).alias(line)).agg(*[F.bit_or(F.when(word == i, bit)).alias(w) for i, w in enumerate(words)])
    rows = df.withColumn(h, hashed).withColumn(line, F.floor(F.col(h) / width)).join(F.broadcast(maps), line, "left")
    own = F.lit(None).cast("long")
    for i, w in enumerate(words):
        own = F.when(word == i, F.col(w)).otherwise(own)
    found = F.coalesce(F.getbit(own, (F.col(h) % 64).cast("int")) == 1, F.lit(False))
    return rows.withColumn(flag, found).drop(line, h, *words)


def only(df: DataFrame, on: Sequence[str], keys: DataFrame) -> DataFrame:
    """The rows of ``df`` that :func:`among` flags: all whose key is in ``keys``, and few others."""
    (flag,) = fresh(df, "flag")
    return among(df, on, keys, flag).filter(flag).drop(flag)


def without(df: DataFrame, on: Sequence[str], keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key isn't in ``keys``; only rows that may be are shuffled."""
    (flag,) = fresh(df, "flag")
    marked = among(df, on, keys, flag)
    maybe = marked.filter(flag).drop(flag).join(keys.select(*on).hint("merge"), list(on), "left_anti")
    return marked.filter(~F.col(flag)).drop(flag).unionByName(maybe.select(*df.columns))


def hot_keys(df: DataFrame, key: Column, total: int, share: float = HOT_SHARE) -> list:
    """The values of ``key`` that hold more than ``share`` of ``total`` rows.

    Counting is combined on the map side; the list has at most 1 / share items.
    """
    least = max(1000.0, total * share)
    found = df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return [r["k"] for r in found.collect()]


def join_by_size(facts: DataFrame, dim: DataFrame, on: Sequence[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``facts`` with one row per key of ``dim``, safe for hot keys.

    ``dim[rows]`` says how many facts share the key. Keys with more than
    HOT_SHARE of ``total`` (fewer than 1 / HOT_SHARE of them, whatever the data)
    go by broadcast, so that no task gets all rows of one; others by shuffle.
    """
    hot = dim.filter(F.col(rows) > max(1000.0, total * HOT_SHARE))
    cold = dim.filter(F.col(rows) <= max(1000.0, total * HOT_SHARE))
    keys = hot.select(*on)
    return facts.join(F.broadcast(hot), list(on)).unionByName(
        facts.join(F.broadcast(keys), list(on), "left_anti").join(cold, list(on))
    )


def join_salted(facts: DataFrame, dim: DataFrame, on: str, rows: str, spread: str) -> DataFrame:
    """Inner join of ``facts`` with large rows of ``dim``, one for each key.

    Both sides have the number of the key's facts as ``rows``. A row of ``dim`` is
    copied for every SALT_ROWS of them, so that no task gets all facts of a key
    and nothing is broadcast, however large the rows of ``dim`` are.
    """
    salts = F.ceil(F.col(rows) / SALT_ROWS)
    (salt,) = fresh(facts, "salt")
    copies = dim.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop(rows)
    return facts.withColumn(salt, F.pmod(F.xxhash64(spread), salts)).join(copies.hint("merge"), [on, salt]).drop(salt)
