"""Replication of a workspace's files to other hosts.

``Replica`` is the interface; ``LocalOnly`` does nothing, and ``SharedFolder`` exchanges
changes through a folder that all hosts reach:

    SHARED/batches/HOST/N/    a host's N-th batch: versions of files, with their content

A batch never changes once it is there. Each host keeps, beside its own files, the
version of every path that it has, and how many batches of each host it has seen (a
version vector). An exchange writes what changed here as a batch, takes the batches
that it hasn't seen, and keeps the version with the latest (time, host) of each path. A
version's time is later than that of the version it replaces, so a host that has seen
a change wins over it. Hosts that have seen the same batches hold the same files, in
whatever order and however often they have seen them.

Transports such as git are left to the caller.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import files, tree


@runtime_checkable
class Replica(Protocol):
    def add_file(self, path: str) -> None:
        """Take a file into the next exchange."""

    def remove_file(self, path: str) -> None:
        """Take a file out of the next exchange."""

    def sync(self) -> None:
        """Exchange with the other hosts."""


class LocalOnly:
    """Nothing is replicated."""

    def add_file(self, path: str) -> None:
        pass

    def remove_file(self, path: str) -> None:
        pass

    def sync(self) -> None:
        pass


VERSION = "path string, time bigint, host string, deleted boolean, hash string"
#: What a host remembers: versions, and how the file looked when it was compared last.
STATE = f"{VERSION}, mtime bigint, length bigint"
BATCH = f"{VERSION}, content binary"


def newest_versions(versions: DataFrame) -> DataFrame:
    """One row for each path: the version with the latest time, and of these the one of the last host by name."""
    rest = [c for c in versions.columns if c != "path"]
    order = F.struct("time", "host", *[c for c in rest if c not in ("time", "host")])
    return versions.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("v")).select("path", "v.*")


def _inside(path: Column) -> Column:
    """Below the root, whatever a host has written."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


class SharedFolder:
    """``host`` names this one among the hosts; ``keep`` says which listed files (by ``path``) are exchanged.

    Files, state and shared folder are paths that the executors reach.
    """

    def __init__(self, spark: SparkSession, root: str, shared: str, host: str, state: str | None = None, keep: Callable = files.is_indexed, now: Callable[[], int] = time.time_ns):
        if not host or "/" in host or host.startswith("."):
            raise ValueError(f"{host!r} cannot name a folder")
        self.spark, self.root, self.host, self.keep, self.now = spark, root.rstrip("/"), host, keep, now
        self.batches, self.state = f"{shared.rstrip('/')}/batches", state or f"{self.root}/.quarry/replica"
        self.told: set[str] = set()

    # the workspace tells what changed; an exchange looks at the whole tree in any case

    def add_file(self, path: str) -> None:
        self.told.add(path)

    def remove_file(self, path: str) -> None:
        self.told.add(path)

    # -- what this host knows

    def _held(self) -> dict:
        path = f"{self.state}/CURRENT.json"
        return json.loads(Path(path).read_text()) if os.path.exists(path) else {"versions": None, "seen": {}, "sent": 0}

    def versions(self) -> DataFrame:
        """The version of every path that this host has, deleted ones too."""
        name = self._held()["versions"]
        if not name:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.state}/{name}")

    def seen(self) -> dict[str, int]:
        """How many batches of each host are in: the version vector."""
        return self._held()["seen"]

    def _save(self, versions: DataFrame, seen: dict[str, int], sent: int) -> None:
        name = f"versions-{uuid.uuid4().hex[:12]}"
        versions.select(*[c.split()[0] for c in STATE.split(", ")]).write.parquet(f"{self.state}/{name}")
        aside = Path(f"{self.state}/CURRENT-{uuid.uuid4().hex}")
        aside.write_text(json.dumps({"versions": name, "seen": seen, "sent": sent}, sort_keys=True))
        aside.rename(f"{self.state}/CURRENT.json")

    # -- one exchange

    def _listed(self) -> DataFrame:
        found = tree.listing(self.spark, self.root).filter(self.keep(F.col("path")))
        return found.select(F.expr(f"substring(path, {len(self.root) + 2})").alias("path"), "mtime", "length")

    def _scratch(self, df: DataFrame) -> DataFrame:
        path = f"{self.state}/scratch-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _changed_here(self, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(versions with content of files that changed or went since the last exchange; files that only look different)."""
        known = held.select("path", F.col("time").alias("old_time"), F.col("hash").alias("old_hash"), "deleted", F.col("mtime").alias("old_mtime"), F.col("length").alias("old_length"))
        both = self._listed().join(known, "path", "full")
        there = F.col("mtime").isNotNull()
        same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("length").eqNullSafe(F.col("old_length"))
        gone = both.filter(~there & ~F.col("deleted"))
        look = both.filter(there & (~same | F.coalesce("deleted", F.lit(True))))
        read = files.read_all(look.select(F.concat(F.lit(f"{self.root}/"), "path").alias("path"), "mtime", "length")).filter(F.col("content").isNotNull())
        read = read.select(F.expr(f"substring(path, {len(self.root) + 2})").alias("path"), "mtime", "length", "content", F.sha2("content", 256).alias("hash")).join(known, "path", "left")
        read = self._scratch(read)
        other = F.coalesce("deleted", F.lit(True)) | ~F.col("hash").eqNullSafe(F.col("old_hash"))
        now = F.greatest(F.lit(self.now() // 1000), F.coalesce("old_time", F.lit(0)) + 1)
        stamped = [now.cast("bigint").alias("time"), F.lit(self.host).alias("host")]
        written = read.filter(other).select("path", *stamped, F.lit(False).alias("deleted"), "hash", "mtime", "length", "content")
        removed = gone.select("path", *stamped, F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("bigint").alias("mtime"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("binary").alias("content"))
        return written.unionByName(removed), read.filter(~other).select("path", F.col("mtime").alias("new_mtime"), F.col("length").alias("new_length"))

    def _send(self, changed: DataFrame, sent: int) -> int:
        """Publish a batch, written aside and renamed; the number of batches sent."""
        if changed.isEmpty():
            return sent
        aside, own = f"{self.batches}/.{self.host}-{uuid.uuid4().hex}", f"{self.batches}/{self.host}/{sent + 1}"
        changed.select(*[c.split()[0] for c in BATCH.split(", ")]).write.parquet(aside)
        os.makedirs(os.path.dirname(own), exist_ok=True)
        os.rename(aside, own)
        return sent + 1

    def _unseen(self, seen: dict[str, int]) -> tuple[list[str], dict[str, int]]:
        """Paths of other hosts' batches that are not in yet, without gaps, and the version vector with them."""
        paths, after = [], dict(seen)
        hosts = sorted(h for h in os.listdir(self.batches) if not h.startswith(".") and h != self.host) if os.path.isdir(self.batches) else []
        for host in hosts:
            there = {int(n) for n in os.listdir(f"{self.batches}/{host}") if n.isdigit()}
            n = after.get(host, 0)
            while n + 1 in there:
                n += 1
                paths.append(f"{self.batches}/{host}/{n}")
            after[host] = n
        return paths, after

    def _apply(self, won: DataFrame) -> DataFrame:
        """Write or delete the files of versions that won, on the executors; their versions with the files' new looks."""
        root = self.root
        arrow = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("length", pa.int64())])

        def write(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    path, deleted, content = (batch.column(c)[i].as_py() for c in range(3))
                    full = os.path.join(root, path)
                    if deleted:
                        Path(full).unlink(missing_ok=True)
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.int64()), pa.array([None], pa.int64())], schema=arrow)
                        continue
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    aside = os.path.join(os.path.dirname(full), f".aside-{uuid.uuid4().hex}")
                    Path(aside).write_bytes(content)
                    os.rename(aside, full)  # a file is seen whole or not at all
                    info = os.stat(full)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(info.st_mtime)], pa.int64()), pa.array([info.st_size], pa.int64())], schema=arrow)

        looks = won.select("path", "deleted", "content").mapInArrow(write, "path string, mtime bigint, length bigint")
        return self._scratch(won.drop("content").join(looks, "path"))

    def sync(self) -> dict[str, int]:
        """Exchange with the other hosts; how many versions were sent and taken.

        Running it again, or after a crash at any point, goes on where it was: a
        batch counts only when it has its name, and what this host knows is replaced
        as a whole at the end.
        """
        held, known = self._held(), self.versions()
        os.makedirs(self.state, exist_ok=True)
        mine = f"{self.batches}/{self.host}"
        unsaved = max((int(n) for n in os.listdir(mine) if n.isdigit()), default=0) if os.path.isdir(mine) else 0
        if unsaved > held["sent"]:  # sent before a crash, so the versions are this host's own already
            lost = self.spark.read.schema(BATCH).parquet(*[f"{mine}/{n}" for n in range(held["sent"] + 1, unsaved + 1)]).drop("content")
            lost = lost.withColumn("mtime", F.lit(None).cast("bigint")).withColumn("length", F.lit(None).cast("bigint"))
            known = newest_versions(known.unionByName(lost))
        changed, looks = self._changed_here(known)
        changed = self._scratch(changed)
        sent = self._send(changed, max(held["sent"], unsaved))
        own = known.join(looks, "path", "left").withColumn("mtime", F.coalesce("new_mtime", "mtime")).withColumn("length", F.coalesce("new_length", "length")).drop("new_mtime", "new_length")
        own = newest_versions(own.unionByName(changed.drop("content")))
        paths, seen = self._unseen(held["seen"])
        taken = 0
        if paths:
            before = own.select("path", F.struct("time", "host").alias("has"))
            come = newest_versions(self.spark.read.schema(BATCH).parquet(*paths)).filter(_inside(F.col("path")))
            won = self._scratch(come.join(before, "path", "left").filter(F.col("has").isNull() | (F.struct("time", "host") > F.col("has"))).drop("has"))
            taken = won.count()
            if taken:
                own = newest_versions(own.unionByName(self._apply(won)))
        n = changed.count()
        self._save(own, seen, sent)
        self.told.clear()
        self._tidy()
        return {"sent": n, "taken": taken}

    def _tidy(self) -> None:
        """Delete this host's scratch and versions that are not the present ones."""
        now = self._held()["versions"]
        for name in os.listdir(self.state):
            if name.startswith(("scratch-", "versions-")) and name != now:
                shutil.rmtree(f"{self.state}/{name}")
