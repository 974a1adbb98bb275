"""A directory tree as a data source: its listing, and the stream of what changes in it.

Executors list the tree. Folders are dealt out by their first DEPTH names below the
root: a partition looks at the folders above that depth and goes down into those that
are its own, so the driver lists nothing, and no list of the tree comes to it.

The stream's offsets are times. A partition keeps what it listed at each offset in a
state folder; a batch from one offset to the next is the difference of two such
snapshots. The later one is made when the batch is read first and is used again
whenever it is read once more, by another action, a retried task or after a restart,
so a batch always holds the same events.

Tree and state folder are paths that all executors reach (a shared file system).
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "quarry_tree"
#: Names of a folder's path that decide where it is listed, and partitions of a listing.
DEPTH, BUCKETS = 2, 32
ROWS = 5000

_ARROW = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("length", pa.int64()), ("event", pa.string())])
_Listed = tuple[str, int, int]


def walk(root: str, depth: int = 0, buckets: int = 1, bucket: int = 0, hidden: bool = False) -> Iterator[_Listed]:
    """(path, seconds of last change or 0, length) of files; links are not followed.

    Hidden folders below the root are left out unless ``hidden`` is set, hidden
    files never are. With several buckets only the files of one's folders are given.
    A folder that cannot be read is left out, but the root must be there.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no folder {root} here; do all executors reach it?")
    waiting = [(root, ())]
    while waiting:
        folder, names = waiting.pop()
        own = crc32("/".join(names[:depth]).encode("utf-8", "surrogateescape")) % buckets == bucket
        if not own and len(names) >= depth:
            continue
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError:
            continue
        for entry in entries:
            if entry.is_symlink() or not _is_text(entry.name):
                continue
            if entry.is_dir(follow_symlinks=False):
                if hidden or not entry.name.startswith("."):
                    waiting.append((entry.path, (*names, entry.name)))
            elif own:
                try:
                    info = entry.stat(follow_symlinks=False)
                    yield entry.path, int(info.st_mtime), info.st_size
                except OSError:
                    yield entry.path, 0, 0


def _is_text(name: str) -> bool:
    """A name that isn't UTF-8 cannot be a Spark string."""
    return not any("\udc80" <= c <= "\udcff" for c in name)


@dataclass
class Bucket(InputPartition):
    number: int


@dataclass
class Step(InputPartition):
    number: int
    start: int
    end: int


class _Options:
    def __init__(self, options):
        self.root = options["root"].rstrip("/") or "/"
        self.depth, self.buckets = int(options.get("depth", DEPTH)), int(options.get("buckets", BUCKETS))
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.state = options.get("state")

    def list(self, bucket: int) -> Iterator[_Listed]:
        return walk(self.root, self.depth, self.buckets, bucket, self.hidden)


def _batches(rows: Iterator[tuple[str, int, int, str | None]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Bucket]:
        return [Bucket(i) for i in range(self.options.buckets)]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return _batches((*row, None) for row in self.options.list(partition.number))


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: _Options):
        if not options.state:
            raise ValueError("a stream of a tree needs the option 'state', a folder for its snapshots")
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": 0, "buckets": self.options.buckets}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1000, "buckets": self.options.buckets}

    def partitions(self, start: dict, end: dict) -> list[Step]:
        if start["buckets"] != end["buckets"]:
            raise ValueError(f"this stream was started with {start['buckets']} buckets")
        return [Step(i, start["at"], end["at"]) for i in range(end["buckets"])]

    def _path(self, at: int, bucket: int) -> str:
        return os.path.join(self.options.state, f"{at}-{bucket}.parquet")

    def _held(self, at: int, bucket: int) -> dict[str, tuple[int, int]]:
        rows = pq.read_table(self._path(at, bucket))
        return dict(zip(rows["path"].to_pylist(), zip(rows["mtime"].to_pylist(), rows["length"].to_pylist(), strict=True), strict=True))

    def _snapshot(self, at: int, bucket: int) -> dict[str, tuple[int, int]]:
        """What the bucket's folders hold at an offset: what was found there first."""
        path = self._path(at, bucket)
        if not os.path.exists(path):
            rows = list(self.options.list(bucket))
            os.makedirs(self.options.state, exist_ok=True)
            aside = f"{path}.{uuid.uuid4().hex}"
            pq.write_table(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW) if i < 3], names=_ARROW.names[:3]), aside)
            try:
                os.link(aside, path)  # another attempt of this task may have been first
            except FileExistsError:
                pass
            os.remove(aside)
        return self._held(at, bucket)

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        old = self._held(partition.start, partition.number) if partition.start else {}
        new = self._snapshot(partition.end, partition.number)

        def events() -> Iterator[tuple[str, int, int, str]]:
            for path in sorted(old.keys() - new.keys()):
                yield (path, *old[path], "delete")
            for path in sorted(new):
                if path not in old:
                    yield (path, *new[path], "insert")
                elif old[path] != new[path]:
                    yield (path, *new[path], "change")

        return _batches(events())

    def commit(self, end: dict) -> None:
        """Snapshots before a finished batch's end are never asked for again."""
        if not os.path.isdir(self.options.state):
            return
        for name in os.listdir(self.options.state):
            at = name.partition("-")[0]
            if at.isdigit() and int(at) < end["at"]:
                os.remove(os.path.join(self.options.state, name))


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, mtime bigint, length bigint, event string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(_Options(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(_Options(self.options))


def local(path: str) -> str:
    """A path without the scheme of a mounted file system; others cannot be listed here."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is not on a mounted file system")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _registered(spark: SparkSession) -> SparkSession:
    if not getattr(spark, "_quarry_tree", False):
        spark.dataSource.register(Tree)
        spark._quarry_tree = True
    return spark


def listing(spark: SparkSession, root: str, hidden: bool = False, depth: int = DEPTH, buckets: int = BUCKETS) -> DataFrame:
    """path, mtime, length of all files below ``root``, listed by the executors."""
    read = _registered(spark).read.format(FORMAT).options(root=root, depth=depth, buckets=buckets, hidden=hidden)
    return read.load().select("path", "mtime", "length")


def changes(spark: SparkSession, root: str, state: str, depth: int = DEPTH, buckets: int = BUCKETS) -> DataFrame:
    """A stream of path, mtime, length, event (insert, change, delete); ``state`` keeps what was listed last."""
    read = _registered(spark).readStream.format(FORMAT).options(root=root, depth=depth, buckets=buckets, state=state)
    return read.load()
