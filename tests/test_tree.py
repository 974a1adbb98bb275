import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import files, tree
from quarry.sources.store import Store
from quarry.streaming import debounce
from quarry.streaming.watch import index_stream


def make(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text of {name}")


NAMES = ["a.md", ".hidden.md", "x/b.md", "x/.git/c.md", "x/y/d.md", "x/y/z/e.md", "x/y/z/w/f.md", "u/v/g.md", ".cache/h.md", "_i/j.md"]
SEEN = ["a.md", ".hidden.md", "x/b.md", "x/y/d.md", "x/y/z/e.md", "x/y/z/w/f.md", "u/v/g.md", "_i/j.md"]


@pytest.mark.parametrize(("depth", "buckets"), [(0, 1), (1, 4), (2, 3), (5, 16)])
def test_every_file_is_listed_once(spark, tmp_path, depth, buckets):
    root = tmp_path / "tree"
    make(root, NAMES)
    os.symlink(root / "a.md", root / "link.md")
    os.symlink(root / "x", root / "linked")
    found = tree.listing(spark, str(root), depth=depth, buckets=buckets)
    assert sorted(os.path.relpath(r.path, root) for r in found.collect()) == sorted(SEEN)
    assert found.rdd.getNumPartitions() == buckets
    every = tree.listing(spark, str(root), hidden=True, depth=depth, buckets=buckets)
    assert every.count() == len(NAMES)
    assert files.folder_size(spark, str(root)) == sum((root / n).stat().st_size for n in NAMES)


def test_many_files(spark, tmp_path):
    """The driver lists nothing of a tree of 100,000 files."""
    root = tmp_path / "tree"
    for i in range(100):
        folder = root / f"f{i % 10}/g{i}"
        folder.mkdir(parents=True)
        for j in range(1000):
            (folder / f"{j}.md").touch()
    held, os.walk = os.walk, None
    try:
        found = files.listing(spark, str(root))
        assert found.count() == 100_000
    finally:
        os.walk = held
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 50_000


def test_a_root_that_executors_lack(spark, tmp_path):
    with pytest.raises(Exception, match="do all executors reach it"):
        tree.listing(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(ValueError, match="mounted"):
        tree.local("hdfs://host/x")
    assert tree.local("file:///a/b") == tree.local("/a/b") == "/a/b"


def test_a_batch_is_the_same_whenever_it_is_read(tmp_path):
    root, state = tmp_path / "tree", tmp_path / "state"
    make(root, ["a.md", "x/b.md"])
    stream = tree.TreeStream(tree._Options({"root": str(root), "state": str(state), "buckets": "2"}))
    start, end = stream.initialOffset(), stream.latestOffset()

    def read(a, b):
        return sorted((os.path.relpath(r["path"], root), r["event"]) for p in stream.partitions(a, b) for batch in stream.read(p) for r in batch.to_pylist())

    first = read(start, end)
    assert first == [("a.md", "insert"), ("x/b.md", "insert")]
    make(root, ["late.md"])
    (root / "a.md").unlink()
    assert read(start, end) == first
    later = stream.latestOffset()
    assert read(end, later) == read(end, later) == [("a.md", "delete"), ("late.md", "insert")]
    stream.commit(later)
    assert {n.split("-")[0] for n in os.listdir(state)} == {str(later["at"])}
    with pytest.raises(ValueError, match="buckets"):
        stream.partitions({"at": 1, "buckets": 3}, later)


def test_stream_follows_changes_and_deletions_over_restarts(spark, tmp_path):
    root, store, done = tmp_path / "tree", Store(spark, str(tmp_path / "store")), []
    make(root, [*NAMES, "no.bin"])

    def follow():
        index_stream(spark, store, str(root), str(tmp_path / "progress"), once=True, on_batch=lambda n, x: done.append((n, tuple(x)))).awaitTermination()
        assert store.check().count() == 0
        return {os.path.relpath(r.path, root) for r in store.documents().collect()}

    assert follow() == set(SEEN)
    (root / "x/b.md").unlink()
    (root / "a.md").write_text("changed text")
    make(root, ["x/new.md"])
    assert follow() == {*SEEN, "x/new.md"} - {"x/b.md"}
    assert follow() == {*SEEN, "x/new.md"} - {"x/b.md"}
    assert [d for _, d in done] == [(8, 0), (2, 1), (0, 0)]
    assert [r.text for r in store.chunks().filter("doc_path LIKE '%/a.md'").collect()] == ["changed text"]


def test_a_batch_is_applied_once(spark, tmp_path):
    from quarry.sources.indexer import apply_changes

    root, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    make(root, ["a.md", "b.md"])
    listed = tree.listing(spark, str(root)).withColumn("event", F.lit("insert"))
    assert apply_changes(store, listed, batch=("s", 0)) == (2, 0)
    n = store._generation()
    assert apply_changes(store, listed, batch=("s", 0)) == (0, 0) and store._generation() == n
    (root / "a.md").unlink()
    gone = listed.filter("path LIKE '%a.md'").withColumn("event", F.lit("delete"))
    gone = spark.createDataFrame([(str(root / "a.md"), 0, 0, "delete")], gone.schema)
    assert apply_changes(store, gone, batch=("s", 1)) == (0, 1)
    assert apply_changes(store, gone, batch=("s", 2)) == (0, 1)  # of an unknown file: nothing happens
    assert store.applied("s") == 2 and store.applied("other") == -1 and store.documents().count() == 1


def test_bursts_join():
    assert debounce.joined([(0, 0, 1), (5, 5, 2), (11, 11, 3)], 5) == [(0, 5, 2), (11, 11, 3)]
    assert debounce.joined([(0, 4, 1), (10, 12, 2), (7, 7, 3)], 5) == [(0, 12, 2)]  # bridged by a late one
    assert debounce.joined([(3, 3, 9), (3, 3, 2)], 0) == [(3, 3, 9)]
