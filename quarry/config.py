"""Settings: a TOML file of the user, overridden by environment variables.

    sync_interval_minutes = 15      # of ``watch``; none or 0: its own default
    line_ranges = true

    [retrieve]
    db = "parquet"                  # "none": no vectors, every search is full-text

    [retrieve.embedding]
    enabled = true
    provider = "ollama"             # hash, openai, ollama, fastembed
    model = "..."
    dimension = 768
    base_url = "http://host:11434"
    api_key_env = "OPENAI_API_KEY"  # the variable that holds the key, never the key

    [retrieve.hybrid]
    fts_weight = 0.5
    rrf_k = 60

    [sync]
    backend = "auto"                # or "none"
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from enum import StrEnum
from hashlib import md5
from pathlib import Path
from uuid import UUID

from quarry.operators import rank

APP = "quarry"


class VectorStore(StrEnum):
    NONE = "none"
    PARQUET = "parquet"

    @classmethod
    def _missing_(cls, value: object) -> VectorStore | None:
        # names of vector stores that existing files may hold (fixed values): there is one store here
        return cls.PARQUET if value in ("sqlite_vec", "lancedb") else None


class ReplicaKind(StrEnum):
    AUTO = "auto"
    NONE = "none"
    GIT = "git"
    FOLDER = "folder"


@dataclass(frozen=True)
class EmbeddingConfig:
    enabled: bool = False
    provider: str = "hash"
    model: str = ""
    dimension: int = 64
    base_url: str | None = None
    api_key_env: str | None = None

    def options(self) -> dict[str, str]:
        """What the provider is told besides model and dimension."""
        told = {"base": self.base_url, "key_variable": self.api_key_env}
        return {k: v for k, v in told.items() if v}


@dataclass(frozen=True)
class HybridConfig:
    fts_weight: float = 0.5
    k: int = rank.RRF_K


@dataclass(frozen=True)
class ReplicaConfig:
    backend: ReplicaKind = ReplicaKind.AUTO
    remote: str = "origin"
    branch: str | None = None
    path: str | None = None  # the shared folder of the backend "folder"


def _flag(value: str) -> bool:
    return value in ("1", "true", "yes")


#: Environment variable, section, key, and how its text is read. A text that cannot be read is ignored.
OVERRIDES: tuple[tuple[str, str, str, Callable], ...] = (
    ("QUARRY_RETRIEVE_DB", "retrieve", "db", VectorStore),
    ("QUARRY_EMBEDDING_ENABLED", "embedding", "enabled", _flag),
    ("QUARRY_EMBEDDING_PROVIDER", "embedding", "provider", str),
    ("QUARRY_EMBEDDING_MODEL", "embedding", "model", str),
    ("QUARRY_EMBEDDING_API_KEY_ENV", "embedding", "api_key_env", str),
    ("QUARRY_EMBEDDING_BASE_URL", "embedding", "base_url", str),
    ("QUARRY_EMBEDDING_DIMENSION", "embedding", "dimension", int),
    ("QUARRY_HYBRID_FTS_WEIGHT", "hybrid", "fts_weight", float),
    ("QUARRY_HYBRID_K", "hybrid", "k", int),
)


def _build(kind: type, section: Mapping):
    """A section as its dataclass; keys that it does not know are ignored."""
    return kind(**{f.name: section[f.name] for f in fields(kind) if section.get(f.name) is not None})


@dataclass(frozen=True)
class Config:
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    hybrid: HybridConfig = field(default_factory=HybridConfig)
    line_ranges: bool = True
    db: VectorStore = VectorStore.PARQUET
    replica: ReplicaConfig = field(default_factory=ReplicaConfig)
    sync_interval_minutes: int | None = None

    @property
    def has_vectors(self) -> bool:
        """Vectors need a store for them, embedding switched on, and a dimension."""
        return self.db != VectorStore.NONE and self.embedding.enabled and self.embedding.dimension > 0

    @property
    def sync_interval(self) -> float | None:
        """Seconds between two cycles of ``watch``, if set."""
        return 60.0 * self.sync_interval_minutes if self.sync_interval_minutes else None

    @classmethod
    def load(cls, held: Mapping | None = None, env: Mapping[str, str] | None = None) -> Config:
        """From nested mappings; environment variables override.

        ``embedding`` and ``hybrid`` may stand in ``retrieve`` or by themselves.
        """
        held, env = held or {}, os.environ if env is None else env
        retrieve = dict(held.get("retrieve", {}))
        parts = {"retrieve": retrieve} | {n: dict(retrieve.get(n) or held.get(n) or {}) for n in ("embedding", "hybrid")}
        if "rrf_k" in parts["hybrid"]:
            parts["hybrid"].setdefault("k", parts["hybrid"]["rrf_k"])
        for name, section, key, kind in OVERRIDES:
            if name in env:
                try:
                    parts[section][key] = kind(env[name])
                except ValueError:
                    continue
        sync = dict(held.get("sync", {}))
        if "backend" in sync:
            sync["backend"] = ReplicaKind(sync["backend"])
        return cls(
            _build(EmbeddingConfig, parts["embedding"]), _build(HybridConfig, parts["hybrid"]), held.get("line_ranges", True),
            VectorStore(retrieve.get("db", VectorStore.PARQUET)), _build(ReplicaConfig, sync), held.get("sync_interval_minutes"),
        )

    @classmethod
    def read(cls, path: str | Path | None = None, env: Mapping[str, str] | None = None) -> Config:
        """From the user's file (none: defaults) and the environment; a broken file is an error that names it."""
        found = Path(path) if path else Folders.of(env).config / "config.toml"
        if not found.exists():
            return cls.load({}, env)
        try:
            return cls.load(tomllib.loads(found.read_text(encoding="utf-8")), env)
        except (ValueError, TypeError) as e:
            raise ValueError(f"cannot read the configuration in {found}: {e}") from e


def path_id(path: str | Path) -> UUID:
    """The same id for the same path on any device: its MD5, marked as a version 8 UUID."""
    raw = bytearray(md5(str(path).encode()).digest())
    raw[6] = 0x80 | raw[6] & 0x0F
    raw[8] = 0x80 | raw[8] & 0x3F
    return UUID(bytes=bytes(raw))


@dataclass(frozen=True)
class Folders:
    """Where this host keeps its own files; the store stays with the workspace, where executors reach it."""

    config: Path
    data: Path
    cache: Path

    @classmethod
    def of(cls, env: Mapping[str, str] | None = None) -> Folders:
        """By the XDG variables."""
        env = os.environ if env is None else env
        home = Path(env.get("HOME") or Path.home())
        places = (("XDG_CONFIG_HOME", ".config"), ("XDG_DATA_HOME", ".local/share"), ("XDG_CACHE_HOME", ".cache"))
        return cls(*[Path(env.get(name) or home / below) / APP for name, below in places])

    def cache_for(self, root: str | Path) -> Path:
        return self.cache / str(path_id(root))

    @property
    def models(self) -> Path:
        return self.cache / "models"
