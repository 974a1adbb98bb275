"""Text files of a directory tree as DataFrames, and single-file access."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import extension
from quarry.operators.chunkers import Chunkers
from quarry.sources import tree

#: Suffixes that are indexed as paragraphs and as JSON lines (fixed values).
TEXT_EXTENSIONS = ("md", "markdown", "txt", "rst", "org")
JSONL_EXTENSIONS = ("jsonl",)


class PathEscapesRootError(ValueError):
    """The path is outside the root."""


def is_indexed(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS, *JSONL_EXTENSIONS)


def is_jsonl(path: Column) -> Column:
    return extension(path).isin(*JSONL_EXTENSIONS)


def listing(spark: SparkSession, root: str, chunkers: Chunkers | None = None) -> DataFrame:
    """path, mtime, length of the files that are indexed, listed by the executors.

    Spark's own file source skips names that start with ``.`` or ``_``; this one
    skips hidden folders only. ``chunkers`` may add extensions.
    """
    kind = is_indexed(F.col("path"))
    return tree.listing(spark, root).filter(kind | chunkers.handles(F.col("path")) if chunkers else kind)


def read_all(files: DataFrame) -> DataFrame:
    """The files with their ``content``, null where a file cannot be read.

    Executors read the files, a few at a time.
    """
    arrow = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                content = []
                for path in batch.column(0).to_pylist():
                    try:
                        content.append(Path(path).read_bytes())
                    except OSError:
                        content.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary())], schema=arrow)

    return files.select("path", "mtime", "length").mapInArrow(read, "path string, mtime bigint, length bigint, content binary")


def text_of(raw: DataFrame) -> DataFrame:
    """Files with ``content`` as files with a ``body``; unreadable and non-UTF-8 ones are left out."""
    text = F.col("content").cast("string")
    return raw.filter(F.col("content").isNotNull() & F.is_valid_utf8(text)).withColumn("body", text).drop("content")


def read_bodies(files: DataFrame) -> DataFrame:
    """The files with their ``body``; unreadable and non-UTF-8 files are left out."""
    return text_of(read_all(files))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One row: the whole file."""
    return spark.createDataFrame([(path, Path(path).read_text())], "path string, body string")


def read_range(docs: DataFrame, start: int, end: int | None = None, body_col: str = "body") -> DataFrame:
    """Lines ``start`` to ``end`` (1-based, both included; to the last line without ``end``).

    Past the last line, and where the end lies before the start, nothing is left.
    """
    from quarry.functions.scalars import lines

    parts = lines(F.col(body_col))
    last = F.least(F.lit(end), F.size(parts)) if end is not None else F.size(parts)
    first = max(start, 1)
    picked = F.when(last >= first, F.slice(parts, F.lit(first), F.greatest(last - first + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("text", F.array_join(picked, "\n"))


def list_dir(spark: SparkSession, root: str, path: str = "") -> DataFrame:
    """path (relative to the root), is_dir of the direct children, by path."""
    folder = resolve(root, path or ".")
    rows = sorted((os.path.relpath(e.path, root), e.is_dir(follow_symlinks=False)) for e in os.scandir(folder))
    return spark.createDataFrame(rows, "path string, is_dir boolean").orderBy("path")


def canonical(path: str | Path) -> Path:
    """The absolute path; components that do not exist are kept as they are."""
    return Path(path).resolve(strict=False)


def resolve(root: str | Path, path: str | Path, inside: bool = True) -> Path:
    """A path below the root (relative ones start there); others are refused if ``inside``."""
    base = canonical(root)
    found = canonical(base / path)
    if inside and not found.is_relative_to(base):
        raise PathEscapesRootError(f"{path} is outside {root}")
    return found


def folder_sizes(files: DataFrame) -> DataFrame:
    """folder, files, size of listed files (path, length), by the folder that they are in."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("size"))


def folder_size(spark: SparkSession, root: str) -> int:
    """Bytes of all files below a folder, hidden folders included."""
    return tree.listing(spark, root, hidden=True).agg(F.sum("length")).first()[0] or 0
