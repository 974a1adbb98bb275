import os
import random
from itertools import count

import pytest
from pyspark.sql import functions as F

from quarry.config import Folders
from quarry.sources.replicate import LocalOnly, Replica, SharedFolder, newest_versions
from quarry.workspace import Config, Workspace


def content(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) if ".quarry" not in d for n in names}


def hosts(spark, tmp_path, names, clock):
    out = {}
    for name in names:
        (tmp_path / name).mkdir()
        out[name] = SharedFolder(spark, str(tmp_path / name), str(tmp_path / "shared"), name, now=lambda: next(clock) * 1_000_000)
    return out


def put(host, path, text):
    full = os.path.join(host.root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def test_two_hosts(spark, tmp_path):
    h = hosts(spark, tmp_path, "ab", count(1))
    a, b = h["a"], h["b"]
    put(a, "x.md", "one")
    put(a, "no.bin", "not exchanged")
    assert a.sync() == {"sent": 1, "taken": 0} and b.sync() == {"sent": 0, "taken": 1}
    assert content(b.root) == {"x.md": "one"} and b.seen() == {"a": 1}
    put(b, "x.md", "two!")
    put(b, "sub/y.md", "new")
    assert b.sync() == {"sent": 2, "taken": 0} and a.sync() == {"sent": 0, "taken": 2}
    assert content(a.root) == {"x.md": "two!", "sub/y.md": "new", "no.bin": "not exchanged"}
    os.remove(f"{a.root}/sub/y.md")
    assert a.sync()["sent"] == 1 and b.sync()["taken"] == 1 and content(b.root) == {"x.md": "two!"}
    for _ in range(2):  # nothing is left to do
        assert a.sync() == b.sync() == {"sent": 0, "taken": 0}
    put(a, "x.md", "at a")
    put(b, "x.md", "at b, later")
    a.sync(), b.sync(), a.sync()
    assert content(a.root)["x.md"] == content(b.root)["x.md"] == "at b, later"
    os.utime(f"{a.root}/x.md", (5, 5))
    assert a.sync() == {"sent": 0, "taken": 0}  # only the time differs


def test_three_hosts_in_any_order(spark, tmp_path):
    rng, clock = random.Random(2), count(1)
    h = hosts(spark, tmp_path, "abc", clock)
    for step in range(9):
        host = h[rng.choice("abc")]
        for _ in range(rng.randint(0, 3)):
            path = f"{rng.choice('pq')}/{rng.randint(0, 3)}.md"
            if rng.random() < 0.7:
                put(host, path, f"step {step} at {host.host} " + "x" * rng.randint(0, 9))
            elif os.path.exists(f"{host.root}/{path}"):
                os.remove(f"{host.root}/{path}")
        host.sync()
    for name in "abcab":
        h[name].sync()
    assert content(h["a"].root) == content(h["b"].root) == content(h["c"].root)
    held = [sorted((r.path, r.time, r.host, r.deleted, r.hash) for r in h[n].versions().collect()) for n in "abc"]
    assert held[0] == held[1] == held[2] and held[0]


def test_after_a_crash(spark, tmp_path, monkeypatch):
    h = hosts(spark, tmp_path, "ab", count(1))
    a, b = h["a"], h["b"]
    put(a, "x.md", "one")
    with monkeypatch.context() as m:
        m.setattr(a, "_save", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            a.sync()  # the batch is out, but a doesn't know it
    assert b.sync()["taken"] == 1
    put(b, "x.md", "two")
    b.sync()
    assert a.sync() == {"sent": 0, "taken": 1} and content(a.root) == {"x.md": "two"}


def test_paths_stay_inside(spark, tmp_path):
    a = hosts(spark, tmp_path, "a", count(1))["a"]
    rows = [(p, 5, "z", False, "h", b"evil") for p in ("../out.md", "/tmp/out.md", "good.md")]
    spark.createDataFrame(rows, "path string, time bigint, host string, deleted boolean, hash string, content binary").write.parquet(str(tmp_path / "shared/batches/z/1"))
    assert a.sync()["taken"] == 1 and content(a.root) == {"good.md": "evil"} and not (tmp_path / "out.md").exists()
    with pytest.raises(ValueError):
        SharedFolder(spark, a.root, str(tmp_path), "../x")


def test_newest_is_the_same_in_any_order(spark):
    rows = [("p", t, h, d, f"{t}{h}") for t in (1, 2, 2) for h, d in (("a", False), ("b", True))]
    df = spark.createDataFrame(rows, "path string, time bigint, host string, deleted boolean, hash string")
    one = newest_versions(df).collect()
    assert one == newest_versions(df.orderBy(F.rand(3))).collect() == newest_versions(newest_versions(df).unionByName(df)).collect()
    assert (one[0].time, one[0].host, one[0].deleted) == (2, "b", True)


def test_as_a_workspace_s_replica(spark, tmp_path):
    h = hosts(spark, tmp_path, "ab", count(1))
    assert isinstance(h["a"], Replica) and isinstance(LocalOnly(), Replica)
    w = Workspace(spark, h["a"].root, Config.load({}, {}), replica=h["a"])
    w.write_file("n.md", "note")
    w.replica.sync()
    h["b"].sync()
    assert content(h["b"].root)["n.md"] == "note"


def test_configured_hosts(spark, tmp_path, monkeypatch):
    """Two workspaces whose configuration names a shared folder."""
    made = []
    for name in "ab":
        (tmp_path / name).mkdir()
        monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / f"data-{name}"))
        config = Config.load({"sync": {"backend": "folder", "path": str(tmp_path / "shared")}}, {})
        made.append(Workspace(spark, tmp_path / name, config, folders=Folders.of()))
    a, b = made
    assert a.replica.host != b.replica.host
    a.write_file("n.md", "hello from a")
    assert (a.exchange(), b.exchange()) == (0, 1)
    assert [r.text for r in b.store.chunks().collect()] == ["hello from a"]
    b.delete_file("n.md")
    assert (b.exchange(), a.exchange()) == (0, 1) and a.store.documents().count() == 0
