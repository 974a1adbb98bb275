"""A workspace: a directory tree with a marker folder and a store."""

from __future__ import annotations

import platform
import socket
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from enum import StrEnum
from pathlib import Path
from uuid import UUID, uuid4

from pyspark.sql import DataFrame, SparkSession

from quarry import schemas
from quarry.config import APP, Config, Folders, ReplicaKind, path_id
from quarry.operators.chunkers import Chunkers
from quarry.operators.embed import Embedder, build_embedder
from quarry.sources import devices, files, indexer
from quarry.sources.replicate import LocalOnly, Replica, SharedFolder
from quarry.sources.store import Store

MARKER = ".quarry"
#: Up to so many chunks are embedded on the way to a search.
EMBED_ON_SEARCH = 50


class SearchMode(StrEnum):
    FTS = "fts"
    SEMANTIC = "semantic"
    HYBRID = "hybrid"


@dataclass(frozen=True)
class RetrieveParams:
    query: str
    limit: int = 10
    mode: SearchMode = SearchMode.HYBRID
    folder: str | None = None


def find_root(start: str | Path) -> Path | None:
    """The nearest folder at or above ``start`` that holds the marker."""
    here = files.canonical(start)
    return next((p for p in (here, *here.parents) if (p / MARKER).is_dir()), None)


def init(path: str | Path) -> Path:
    """Make a folder a workspace."""
    root = files.canonical(path)
    (root / MARKER).mkdir(parents=True, exist_ok=True)
    return root


def workspace_id(root: str | Path) -> UUID:
    """The same for the same path on any device."""
    return path_id(files.canonical(root))


def device_id(folder: str | Path) -> str:
    """This device's id, made on first use."""
    path = Path(folder) / "device_id"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        now = int(datetime.now(UTC).timestamp() * 1000)
        path.write_text(str(UUID(int=(now << 80) | (0x7 << 76) | (uuid4().int & ((1 << 76) - 1) & ~(0x3 << 62)) | (0x2 << 62))))
    return path.read_text().strip()


class Workspace:
    """``replica`` is told of every file that is written or deleted, unless the configuration says ``none``.

    ``chunkers`` adds chunkers, and extensions that are indexed by them.
    """

    def __init__(
        self, spark: SparkSession, root: str | Path, config: Config | None = None, store_path: str | None = None,
        replica: Replica | None = None, folders: Folders | None = None, chunkers: Chunkers | None = None,
    ):
        self.spark, self.root, self.config = spark, str(files.canonical(root)), config or Config()
        self.store = Store(spark, store_path or f"{self.root}/{MARKER}/store")
        self.folders, self.chunkers = folders or Folders.of(), chunkers
        if replica is None and self.config.replica.backend == ReplicaKind.FOLDER and self.config.replica.path:
            replica = SharedFolder(spark, self.root, self.config.replica.path, self.device)
        self.replica: Replica = replica if replica and self.config.replica.backend != ReplicaKind.NONE else LocalOnly()

    @property
    def embedder(self) -> Embedder | None:
        """None unless vectors are configured."""
        e = self.config.embedding
        return build_embedder(e.provider, e.model, e.dimension, **e.options()) if self.config.has_vectors else None

    # -- indexing

    def sync(self) -> indexer.Synced:
        return indexer.sync(self.spark, self.store, self.root, self.config.line_ranges, self.chunkers)

    def refresh(self) -> indexer.Synced:
        return indexer.sync_incremental(self.spark, self.store, self.root, self.config.line_ranges, self.chunkers)

    def embed_pending(self, on_progress: Callable[[int, int], None] | None = None) -> int:
        embedder = self.embedder
        return self.store.embed_pending(embedder, on_progress) if embedder else 0

    def sync_and_embed(self) -> tuple[int, int, int]:
        return (*self.refresh(), self.embed_pending())

    def exchange(self) -> int:
        """Exchange with the other hosts and index what came from them; how many files that were."""
        taken = (self.replica.sync() or {}).get("taken", 0)
        if taken:
            self.refresh()
        return taken

    def rebuild(self) -> tuple[int, int]:
        self.store.rebuild()
        return self.sync()

    # -- files

    def path(self, path: str) -> Path:
        return files.resolve(self.root, path)

    def read_file(self, path: str) -> str:
        return self.path(path).read_text()

    def read_range(self, path: str, start: int, end: int | None = None) -> str:
        return files.read_range(files.read_file(self.spark, str(self.path(path))), start, end).first()["text"]

    def list_dir(self, path: str = "") -> DataFrame:
        return files.list_dir(self.spark, self.root, path)

    def write_file(self, path: str, text: str) -> None:
        found = self.path(path)
        found.parent.mkdir(parents=True, exist_ok=True)
        found.write_text(text)
        self.on_event(str(found))

    def append_file(self, path: str, text: str) -> None:
        found = self.path(path)
        self.write_file(path, (found.read_text() if found.exists() else "") + text)

    def delete_file(self, path: str) -> None:
        found = self.path(path)
        found.unlink()
        self.on_event(str(found))

    def forget(self, path: str) -> None:
        """Take one file out of the index, whether it exists or not."""
        found = str(self.path(path))
        indexer.delete_file(self.spark, self.store, self.root, found)
        self.replica.remove_file(found)

    def on_event(self, path: str) -> bool:
        """Follow one file that changed: it is indexed if it exists and forgotten if not. True if it is indexed now."""
        found = str(self.path(path))
        indexed = indexer.apply_event(self.spark, self.store, self.root, found, self.config.line_ranges, self.chunkers)
        (self.replica.add_file if Path(found).exists() else self.replica.remove_file)(found)
        return indexed

    # -- search

    def retrieve(self, params: RetrieveParams) -> DataFrame:
        """Dispatch by mode; the folder is pushed down to each search as a path prefix."""
        embedder, prefix = self.embedder, f"{self.root}/{params.folder}" if params.folder else None
        if params.mode == SearchMode.FTS or (params.mode == SearchMode.SEMANTIC and embedder is None):
            return self.store.search_fts(params.query, params.limit, prefix)
        if params.mode == SearchMode.SEMANTIC:
            return self.store.search_similar(params.query, embedder, params.limit, prefix)
        weight = self.config.hybrid.fts_weight
        return self.store.search_hybrid(params.query, embedder, params.limit, prefix, self.config.hybrid.k, weight, 1 - weight)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The tool server's search: refresh, embed a few pending chunks, fuse with equal weights."""
        self.refresh()
        embedder = self.embedder
        if embedder and 0 < self.store.pending().limit(EMBED_ON_SEARCH + 1).count() <= EMBED_ON_SEARCH:
            self.store.embed_pending(embedder)
        return self.store.search_hybrid(query, embedder, limit)

    def info(self) -> DataFrame:
        return self.store.info()

    # -- devices

    @property
    def registry(self) -> str:
        return f"{self.root}/{MARKER}/devices.jsonl"

    def devices(self) -> DataFrame:
        return devices.load(self.spark, self.registry)

    @property
    def device(self) -> str:
        return device_id(self.folders.data)

    def host(self) -> dict:
        """What this host reports of itself."""
        facts = {"hostname": socket.gethostname(), "app_id": APP, "app_version": str(schemas.VERSION), "platform": platform.system().lower(), "arch": platform.machine()}
        return facts | {"id": self.device, "name": facts["hostname"]}

    def report_device(self, context: dict | None = None) -> bool:
        """Merge a host, this one by default, into the registry; whether that changed it."""
        Path(self.registry).parent.mkdir(parents=True, exist_ok=True)
        changed = devices.merge_file(self.spark, self.registry, context or self.host(), datetime.now(UTC))
        if changed:
            self.replica.add_file(self.registry)
        return changed

    def rename_device(self, target: str, name: str) -> None:
        found = devices.find(self.devices(), target).first()["id"]
        devices.save(devices.set_name(self.devices(), found, name, datetime.now(UTC)), self.registry)
        self.replica.add_file(self.registry)
