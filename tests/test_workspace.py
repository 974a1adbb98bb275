import io
import json
import os

import pytest

from quarry import cli, tools
from quarry.config import Config, Folders, ReplicaKind, VectorStore
from quarry.operators.embed import Embedder, build_embedder, hash_embedder, openai_embedder
from quarry.sources import files, indexer
from quarry.sources.replicate import LocalOnly, Replica
from quarry.sources.store import Store
from quarry.workspace import RetrieveParams, SearchMode, Workspace, init

FILE = """
sync_interval_minutes = 15
[sync]
backend = "none"
remote = "elsewhere"
[retrieve]
db = "sqlite_vec"
[retrieve.embedding]
enabled = true
provider = "openai"
model = "m"
dimension = 8
unknown = 1
[retrieve.hybrid]
fts_weight = 0.25
rrf_k = 10
"""


@pytest.fixture
def home(tmp_path, monkeypatch):
    for name in ("CONFIG", "DATA", "CACHE"):
        monkeypatch.setenv(f"XDG_{name}_HOME", str(tmp_path / name.lower()))
    return tmp_path


@pytest.fixture
def root(home):
    found = init(home / "tree")
    (found / "a.md").write_text("Hello world.\n\nThe license text.")
    (found / "b.txt").write_text("hello again")
    return found


def test_configuration_file(home):
    assert Config.read(env=dict(os.environ)) == Config()
    path = Folders.of().config / "config.toml"
    path.parent.mkdir(parents=True)
    path.write_text(FILE)
    held = Config.read()
    assert (held.db, held.has_vectors, held.sync_interval) == (VectorStore.PARQUET, True, 900.0)
    assert (held.hybrid.k, held.hybrid.fts_weight, held.replica.backend, held.replica.remote) == (10, 0.25, ReplicaKind.NONE, "elsewhere")
    env = {
        "QUARRY_RETRIEVE_DB": "none", "QUARRY_EMBEDDING_ENABLED": "no", "QUARRY_EMBEDDING_PROVIDER": "ollama", "QUARRY_EMBEDDING_MODEL": "n",
        "QUARRY_EMBEDDING_API_KEY_ENV": "KEY", "QUARRY_EMBEDDING_BASE_URL": "http://h", "QUARRY_EMBEDDING_DIMENSION": "16", "QUARRY_HYBRID_K": "x",
    }
    held = Config.read(path, env)
    e = held.embedding
    assert (held.db, held.hybrid.k) == (VectorStore.NONE, 10)
    assert (e.enabled, e.provider, e.model, e.dimension, e.options()) == (False, "ollama", "n", 16, {"base": "http://h", "key_variable": "KEY"})
    assert Config.load({}, {"QUARRY_RETRIEVE_DB": "nonsense", "QUARRY_EMBEDDING_DIMENSION": "many"}) == Config()
    path.write_text("[retrieve")
    with pytest.raises(ValueError, match="config.toml"):
        Config.read()


@pytest.mark.parametrize(("db", "enabled", "dimension", "on"), [("parquet", True, 4, True), ("none", True, 4, False), ("parquet", False, 4, False), ("lancedb", True, 0, False)])
def test_vectors_are_gated(db, enabled, dimension, on):
    assert Config.load({"retrieve": {"db": db, "embedding": {"enabled": enabled, "dimension": dimension}}}, {}).has_vectors is on


def test_without_vectors_every_search_is_by_text(spark, root):
    w = Workspace(spark, root, Config.load({"retrieve": {"db": "none", "embedding": {"enabled": True}}}, {}))
    w.sync()
    assert w.embedder is None and w.embed_pending() == 0
    found = [[r.path for r in w.retrieve(RetrieveParams("license", mode=m)).collect()] for m in SearchMode]
    assert found == [[str(root / "a.md")]] * 3


def test_request_of_an_embedder(monkeypatch):
    import quarry.operators.embed as embed

    sent = []
    monkeypatch.setattr(embed, "_post", lambda url, body, headers: sent.append((url, body, headers)) or {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], "embeddings": [[1], [2]]})
    monkeypatch.setenv("KEY", "secret")
    assert openai_embedder("m", 1, "http://h/", "KEY")(["a", "b"]).tolist() == [[1], [2]]
    assert sent[0] == ("http://h/v1/embeddings", {"model": "m", "input": ["a", "b"]}, {"Authorization": "Bearer secret"})
    assert build_embedder("ollama", "m", 1, base="http://o", key_variable="KEY")(["a", "b"]).tolist() == [[1], [2]]
    assert sent[1][:2] == ("http://o/api/embed", {"model": "m", "input": ["a", "b"]})
    with pytest.raises(ValueError, match="AllMiniLML6V2"):
        build_embedder("fastembed", "nobody")


def test_progress_of_embedding(spark, root):
    w = Workspace(spark, root)
    w.sync()
    said = []
    n = w.store.embed_pending(hash_embedder(4), lambda done, total: said.append((done, total)))
    assert n == 3 and said[-1] == (3, 3) and said == sorted(said)
    said.clear()
    assert w.store.embed_pending(hash_embedder(4), lambda *x: said.append(x)) == 0 and not said
    w.store.ensure_dimension(2)
    with pytest.raises(Exception, match="numbers each"):
        w.store.embed_pending(Embedder(lambda texts: [[1.0]] * len(texts), 2), lambda *x: said.append(x))
    assert (3, 3) not in said


def test_events_on_single_files(spark, root):
    told = []

    class Told(LocalOnly):
        def add_file(self, path):
            told.append(("add", os.path.basename(path)))

        def remove_file(self, path):
            told.append(("remove", os.path.basename(path)))

    assert isinstance(Told(), Replica)
    w = Workspace(spark, root, replica=Told())
    assert w.on_event("a.md") and w.on_event("b.txt")
    (root / "b.txt").unlink()
    assert not w.on_event("b.txt") and not w.on_event("never.md")
    (root / "x.bin").write_text("hello")
    assert not w.on_event("x.bin")
    assert [r.path for r in w.store.documents().collect()] == [str(root / "a.md")]
    assert told == [("add", "a.md"), ("add", "b.txt"), ("remove", "b.txt"), ("remove", "never.md"), ("add", "x.bin")]
    with pytest.raises(files.PathEscapesRootError):
        w.on_event("../outside.md")
    with pytest.raises(FileNotFoundError):
        indexer.update_file(spark, w.store, w.root, "never.md")
    quiet = Workspace(spark, root, Config.load({"sync": {"backend": "none"}}, {}), replica=Told())
    assert isinstance(quiet.replica, LocalOnly) and not isinstance(quiet.replica, Told)


def test_files_that_executors_do_not_reach(spark, root, monkeypatch):
    store = Store(spark, str(root / "store"))
    empty = lambda listed: listed.selectExpr("path", "mtime", "length", "CAST(NULL AS BINARY) content")
    monkeypatch.setattr(indexer.files, "read_all", empty)
    with pytest.raises(OSError, match="reach"):
        indexer.sync(spark, store, str(root))
    assert store.documents().count() == 0
    monkeypatch.setattr(indexer.os, "access", lambda *_: False)  # nobody can read them: left out
    assert indexer.sync(spark, store, str(root)) == (0, 0)


def run(capsys, root, *args):
    assert cli.main(["--root", str(root), *args]) == 0
    return capsys.readouterr().out


def test_commands(spark, root, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert json.loads(run(capsys, root, "sync")) == {"upserted": 2, "removed": 0, "embedded": 0}
    assert [os.path.basename(x["path"]) for x in json.loads(run(capsys, root, "search", "license"))] == ["a.md"]
    run(capsys, root, "delete", "a.md")
    assert json.loads(run(capsys, root, "cache", "info").split("}")[0] + "}")["document_count"] == 1
    run(capsys, root, "upsert", "a.md")
    assert json.loads(run(capsys, root, "cache", "rebuild")) == {"upserted": 2, "removed": 0}
    assert json.loads(run(capsys, root, "cache", "sync"))["upserted"] == 0
    stale = root / ".quarry/store/v3"
    stale.mkdir()
    (stale / "x").write_text("12345")
    assert run(capsys, root, "cache", "clean").endswith("v3 (5 bytes)\n") and not stale.exists()
    assert run(capsys, root, "cache", "clean") == "nothing to clean\n"
    assert len(json.loads(run(capsys, root, "search", "hello"))) == 2
    run(capsys, root, "device", "set-name", "desk")
    assert "desk" in run(capsys, root, "device", "list") and "desk" in run(capsys, root, "device", "show")
    assert "desk" in run(capsys, root, "device", "show", "1")
    (root / "b.txt").unlink()
    assert run(capsys, root, "watch", "--cycles", "1", "--interval", "0") == "0 indexed, 1 removed\n"
    assert run(capsys, root, "cache", "embed") == "0\n"
    assert "problem" in run(capsys, root, "cache", "check") and run(capsys, root, "cache", "cells") == ""
    (root / "late.md").write_text("hello late")
    progress = str(root.parent / "progress")
    assert "indexed, 0 removed" in run(capsys, root, "watch", "--cycles", "1", "--progress", progress)
    (root / "late.md").unlink()
    assert run(capsys, root, "watch", "--cycles", "1", "--progress", progress) == "batch 1: 0 indexed, 1 removed\n"
    assert cli.main(["--root", str(root.parent), "sync"]) == 1


def test_device_id_is_kept(spark, root):
    a, b = Workspace(spark, root).device, Workspace(spark, root).device
    assert a == b and a[14] == "7" and (Folders.of().data / "device_id").read_text() == a
    assert not Folders.of().cache_for(root).is_relative_to(root) and Folders.of().models.name == "models"


def test_tool_server(spark, root):
    def ask(*messages):
        sink = io.StringIO()
        tools.serve(Workspace(spark, root), io.StringIO("".join(m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0"} | m) + "\n" for m in messages)), sink)
        return [json.loads(x) for x in sink.getvalue().splitlines()]

    def call(n, name, **given):
        return {"id": n, "method": "tools/call", "params": {"name": name, "arguments": given}}

    said = ask({"id": 0, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, "\n", {"id": "x", "method": "tools/list"}, {"id": 2, "method": "ping"})
    assert [x["id"] for x in said] == [0, "x", 2] and said[0]["result"]["capabilities"] == {"tools": {}}
    assert [t["name"] for t in said[1]["result"]["tools"]] == list(tools.TOOLS)
    said = ask(call(1, "workspace_sync"), call(2, "search", query="license", limit=None), call(3, "search", query="hello", limit=1), call(4, "workspace_info"), call(5, "workspace_rebuild"))
    shown = [json.loads(x["result"]["content"][0]["text"]) for x in said]
    assert shown[0]["upserted"] == 2 and [os.path.basename(x["path"]) for x in shown[1]] == ["a.md"] and len(shown[2]) == 1
    assert shown[1][0]["chunks"][0]["line_start"] == 2 and shown[3]["document_count"] == 2 and shown[4] == {"upserted": 2, "removed": 0}
    said = ask("{\n", "[1]\n", {"id": 1, "method": "nothing"}, call(2, "nobody"), call(3, "search"), call(4, "search", query="x", limit=-1))
    assert [x["error"]["code"] for x in said[:6]] == [tools.PARSE_ERROR, tools.INVALID_REQUEST, tools.UNKNOWN_METHOD, *[tools.INVALID_PARAMS] * 3]
