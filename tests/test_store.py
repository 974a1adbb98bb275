import os
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import postings, rank
from quarry.operators.embed import build_embedder, hash_embedder
from quarry.sources import devices, files, indexer
from quarry.sources.store import SchemaTooNewError, Store
from quarry.workspace import Config, RetrieveParams, SearchMode, Workspace, find_root, init


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "a.md": "Hello world.\n\nThe license text.", "sub/b.TXT": "hello again", ".hidden.md": "hello hidden file", ".git/c.md": "hello no", "x.bin": "hello no",
        "log.jsonl": '{"role":"user","content":"hello log"}\n', "_u.md": "hello underscore",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.md").write_bytes(b"\xff\xfe hello")
    return root


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


def test_listing_and_reading(spark, tree):
    assert names(files.listing(spark, str(tree)), tree) == [".hidden.md", "_u.md", "a.md", "bad.md", "log.jsonl", "sub/b.TXT"]
    assert "bad.md" not in names(files.read_bodies(files.listing(spark, str(tree))), tree)


def test_sync_and_refresh(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert indexer.sync(spark, store, str(tree)) == (5, 0)
    assert indexer.sync_incremental(spark, store, str(tree)) == (0, 0)
    (tree / "a.md").write_text("Changed license.\n\nThe license text.")
    (tree / "sub/b.TXT").unlink()
    done = indexer.sync_incremental(spark, store, str(tree))
    assert done == (1, 1) and done.actions == {"update_text": 1, "keep": 1}
    assert "sub/b.TXT" not in names(store.files(), tree)
    (tree / "sub/b.TXT").write_text("hello again")
    os.utime(tree / "sub/b.TXT", (1, 1))
    assert indexer.sync_incremental(spark, store, str(tree)) == (1, 0)
    assert [os.path.basename(r.path) for r in store.search_fts("license").collect()] == ["a.md"]


def test_vectors_outlive_unrelated_changes(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    log = root / "log.jsonl"
    log.write_text('{"content":"one"}\n{"content":"two"}\n')
    store, embedder = Store(spark, str(tmp_path / "store")), hash_embedder(8)
    indexer.sync(spark, store, str(root))
    assert store.embed_pending(embedder) == 2
    log.write_text('{"content":"one"}\n{"content":"two"}\n{"content":"three"}\n')
    os.utime(log, (5, 5))
    indexer.sync_incremental(spark, store, str(root))
    assert [r.text for r in store.pending().collect()] == ["three"]
    assert store.embed_pending(embedder) == 1
    assert store.vec_info().first().asDict() == {"embedding_dim": 8, "vector_count": 3, "pending_count": 0}
    log.write_text('{"content":"ONE"}\n{"content":"two"}\n{"content":"three"}\n')
    os.utime(log, (6, 6))
    indexer.sync_incremental(spark, store, str(root))
    assert [r.text for r in store.pending().collect()] == ["ONE"]
    store.ensure_dimension(16)
    assert store.vectors().count() == 0


def test_versions(spark, tmp_path):
    (tmp_path / "s/v9").mkdir(parents=True)
    with pytest.raises(SchemaTooNewError):
        Store(spark, str(tmp_path / "s"))
    (tmp_path / "t/v3").mkdir(parents=True)
    (tmp_path / "t/v3/x").write_text("12345")
    assert [r.size for r in Store(spark, str(tmp_path / "t")).stale().collect()] == [5]


def test_readers_keep_their_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = spark.createDataFrame([("/a", 1, 1)], "path string, mtime bigint, length bigint")
    store.upsert_files(row)
    before = store.files()
    store.upsert_files(row.withColumn("mtime", F.lit(2).cast("bigint")))
    assert before.first().mtime == 1
    assert [r.mtime for r in store.files().collect()] == [2]
    store.remove_files(row)
    assert store.files().count() == 0
    store.vacuum()
    assert store.files().count() == 0


def test_workspace(spark, tree):
    root = init(tree)
    assert find_root(tree / "sub") == root
    w = Workspace(spark, root, Config.load({"embedding": {"enabled": True, "dimension": 16}}, {"QUARRY_HYBRID_K": "50"}))
    assert w.config.hybrid.k == 50
    assert w.sync_and_embed()[0] == 5
    for mode in SearchMode:
        assert w.retrieve(RetrieveParams("hello", mode=mode)).count() > 0
    assert {os.path.basename(r.path) for r in w.retrieve(RetrieveParams("hello", mode=SearchMode.FTS, folder="sub")).collect()} == {"b.TXT"}
    w.write_file("new/n.md", "hello brand new")
    w.append_file("new/n.md", "\n\nsecond part")
    assert w.read_range("new/n.md", 3) == "second part" and w.read_range("new/n.md", 5, 2) == ""
    assert [r.path for r in w.search("second part").collect()][0].endswith("n.md")
    w.delete_file("new/n.md")
    assert not w.store.documents().filter("path LIKE '%/n.md'").count()
    with pytest.raises(files.PathEscapesRootError):
        w.path("../../etc/passwd")
    assert ("sub", True) in [tuple(r) for r in w.list_dir().collect()]


def test_paths_that_do_not_exist(tmp_path):
    assert files.canonical(tmp_path / "a.md") == tmp_path.resolve() / "a.md"
    assert files.canonical(tmp_path / "x/y/a.md") == tmp_path.resolve() / "x/y/a.md"


@pytest.mark.parametrize(("start", "end", "text"), [(1, 2, "a\nb"), (2, 9, "b\nc"), (9, None, ""), (5, 2, ""), (3, 3, "c")])
def test_ranges(spark, start, end, text):
    df = spark.createDataFrame([("a\nb\r\nc\n",)], "body string")
    assert files.read_range(df, start, end).first().text == text


T = datetime(2024, 1, 1, tzinfo=UTC)


def context(**kw):
    return {"id": "1", "name": "n", "hostname": "h", "app_id": "a", "app_version": "1", "platform": "p", "arch": "x"} | kw


def test_devices(spark, tmp_path):
    path = str(tmp_path / "devices.jsonl")
    assert devices.load(spark, path).count() == 0
    assert devices.merge_file(spark, path, context(), T)
    first = devices.load(spark, path).first()
    assert first.registered_at == first.updated_at
    assert not devices.merge_file(spark, path, context(), T + timedelta(1))
    assert devices.merge_file(spark, path, context(hostname="other", name="z"), T)
    held = devices.load(spark, path).first()
    assert (held.hostname, held.name, held.updated_at) == ("other", "n", first.updated_at)
    assert devices.merge_file(spark, path, context(hostname="other", name="newer", updated_at=T + timedelta(2)), T)
    assert not devices.merge_file(spark, path, context(hostname="other", name="older", updated_at=T), T)
    held = devices.load(spark, path).first()
    assert held.name == "newer" and held.registered_at == first.registered_at
    devices.merge_file(spark, path, context(id="0", name="second"), T)
    assert [(r.id, r.number) for r in devices.numbered(devices.load(spark, path)).orderBy("id").collect()] == [("0", 1), ("1", 2)]
    assert devices.find(devices.load(spark, path), "2").first().id == "1"
    with pytest.raises(devices.DeviceNotFoundError):
        devices.set_name(devices.load(spark, path), "nobody", "x", T)
    older = devices.load(spark, path).withColumn("updated_at", F.lit(T - timedelta(9)).cast("timestamp")).withColumn("name", F.lit("no"))
    assert {r.name for r in devices.update_if_newer(devices.load(spark, path), older).collect()} == {"newer", "second"}


def test_bad_registry_line(spark, tmp_path):
    path = tmp_path / "devices.jsonl"
    path.write_text("not-json\n")
    with pytest.raises(devices.RegistryError) as e:
        devices.load(spark, str(path))
    assert e.value.line == 1


def test_embedders():
    embedder = hash_embedder(16)
    assert embedder([]).shape == (0, 16)
    assert (embedder(["a b c"]) == embedder(["a b c"])).all()
    with pytest.raises(ValueError, match="unknown"):
        build_embedder("nobody")
    from quarry.operators.embed import Embedder, vectors_by_index

    assert vectors_by_index({"data": [{"index": 1, "embedding": [2]}]}, 2) == [[], [2.0]]
    with pytest.raises(ValueError, match="vectors"):
        Embedder(lambda texts: [[1.0]], 1)(["a", "b"])


def test_stream(spark, tree, tmp_path):
    from quarry.streaming.watch import index_stream, watch_tree

    store = Store(spark, str(tmp_path / "store"))
    index_stream(spark, store, str(tree), str(tmp_path / "progress"), once=True).awaitTermination()
    assert names(store.documents(), tree) == [".hidden.md", "_u.md", "a.md", "log.jsonl", "sub/b.TXT"]
    (tree / "late.md").write_text("hello late")
    index_stream(spark, store, str(tree), str(tmp_path / "progress"), once=True).awaitTermination()
    assert "late.md" in names(store.documents(), tree)
    (tree / "late.md").unlink()
    (tree / "a.md").write_text("changed")
    said = []
    watch_tree(Workspace(spark, tree, store_path=str(tmp_path / "store")), interval=0, cycles=2, log=said.append)
    assert names(store.documents(), tree) == [".hidden.md", "_u.md", "a.md", "log.jsonl", "sub/b.TXT"] and len(said) == 1


def test_manifests_are_published_whole_and_once(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a._publish("CURRENT-1.json", "{}")
    with pytest.raises(Exception, match="CURRENT-1"):
        b._publish("CURRENT-1.json", '{"files": "other"}')
    assert a.manifest() == {} and not [f for f in os.listdir(a.path) if f.startswith("_aside")]
    staged = [x.stage(spark.range(3)) for x in (a, b)]
    a.clear_stage()
    assert staged[1].count() == 3
    b.clear_stage()


def rows_of(spark, ids, text="the license of {} is apache"):
    documents = spark.createDataFrame([(i, f"/ws/{i}.md") for i in ids], "id bigint, path string")
    chunks = spark.createDataFrame([(i, n, n, text.format(i) + " x" * n, f"/ws/{i}.md") for i in ids for n in range(3)], schemas.CHUNKS)
    return documents, chunks, documents.select("path", F.lit(1).cast("bigint").alias("mtime"), F.lit(2).cast("bigint").alias("length"))


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_a_change_writes_what_it_holds(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert_documents(*rows_of(spark, range(3000)))
    before, first = bytes_below(store.path), store.manifest()["tables"]
    store.upsert_documents(*rows_of(spark, [5], "nothing about {}"))
    assert bytes_below(store.path) - before < before / 10
    assert all(first[t][0] in store.manifest()["tables"][t] for t in first if first[t])
    assert (store.documents().count(), store.chunks().count(), store.files().count()) == (3000, 9000, 3000)
    assert [r.text for r in store.chunks().filter("doc_id = 5 AND line_start = 0").collect()] == ["nothing about 5"]


def test_changes_against_whole_tables(spark, tmp_path):
    """A row of changes that merges parts and clears keys, against a dictionary; searches against all text."""
    store, want = Store(spark, str(tmp_path / "s")), {}
    batches = [(range(40), "first {} apache"), ([1, 2], "second {} license"), ([3], None), ([2, 50], "third {} apache license"), ([50, 3], "again {} aaaa")]
    batches += [([60 + i], "more {} apache") for i in range(9)] + [([1, 60], None), ([1], "back {} license"), (range(30), "late {} apache")]
    for ids, text in batches:
        if text is None:
            store.remove_documents(spark.createDataFrame([(i,) for i in ids], "id bigint"))
        else:
            store.upsert_documents(*rows_of(spark, ids, text))
        for i in ids:
            want.pop(i, None)
            if text:
                want[i] = text.format(i)
    held = {r.doc_id: r.text for r in store.chunks().filter("line_start = 0").collect()}
    assert held == want and store.chunks().count() == 3 * len(want)
    assert {r.id for r in store.documents().collect()} == set(want) == {int(r.path[4:-3]) for r in store.files().collect()}
    assert max(map(len, store.manifest()["tables"].values())) < 8 + 8
    for _ in range(2):
        for query in ("apache", "apache license", "license OR aaaa", "apache NOT late", "aaa", "nowhere", "ap"):
            got, plain = store.search_fts(query, 100), rank.fts_files(store.chunks(), query, 100)
            show = lambda df: [(r.id, round(r.score, 9), len(r.chunks)) for r in df.collect()]
            assert show(got) == show(plain), query
        store.compact()
        store.vacuum()
        assert store.manifest()["gone"] == {"documents": [], "files": []} and {len(p) for p in store.manifest()["tables"].values()} <= {0, 1}
    assert {r.doc_id: r.text for r in store.chunks().filter("line_start = 0").collect()} == want
    assert store.check().count() == 0


def test_pending_is_kept_up_to_date(spark, tmp_path):
    """After every commit of a random row the kept tables are what follows from the chunks."""
    import random

    rng, store, embedder = random.Random(4), Store(spark, str(tmp_path / "s")), hash_embedder(4)
    for step in range(9):
        kind = rng.choice(["write", "write", "remove", "embed", "dimension", "compact"]) if step else "write"
        ids = rng.sample(range(12), 4)
        if kind == "write":
            actions = store.upsert_documents(*rows_of(spark, ids, rng.choice(["first {} text", "second {} text"])))
            assert actions.total() - actions["delete"] == 12
        elif kind == "remove":
            store.remove_documents(spark.createDataFrame([(i,) for i in ids], "id bigint"))
        elif kind == "embed":
            n = store.table("pending").count()
            assert store.embed_pending(embedder) == n and store.table("pending").count() == 0
        elif kind == "dimension":
            embedder = hash_embedder(rng.choice([4, 8]))
            store.ensure_dimension(embedder.dimension)
        else:
            store.compact()
            store.vacuum()
        assert [tuple(r) for r in store.check().collect()] == [], (step, kind)


def test_check_finds_what_is_wrong(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert_documents(*rows_of(spark, range(3)))
    store.commit({"documents": spark.createDataFrame([(1, "/ws/1.md")], "id bigint, path string")})
    store.commit(whole={"pending": store.table("pending").filter("doc_id <> 2"), "postings": store.table("postings").filter("doc_id <> 0")})
    assert {r.problem for r in store.check().collect()} == {"document twice", "not pending", "posting missing"}


def test_check_compares_postings_where_they_are_read(spark, tmp_path, monkeypatch):
    """Rows of the postings are shuffled for documents alone whose sums differ, however many these are."""
    store, words = Store(spark, str(tmp_path / "s")), "ß日本😀 Ab"
    docs = spark.range(100).select("id", F.concat(F.lit("/ws/"), "id", F.lit(".md")).alias("path"))
    text = F.concat(F.lit(words), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2((F.col("id") * 1000 + i).cast("string"), 256))))
    chunks = docs.select(F.col("id").alias("doc_id"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), text.alias("text"), F.col("path").alias("doc_path"))
    store.upsert_documents(docs, chunks)
    want = {(t[i : i + 3], r.doc_id) for r in chunks.collect() for t in [r.text.lower()] for i in range(len(t) - 2)}
    held = [(r.trigram, r.doc_id) for r in store.table("postings").collect()]
    assert len(held) == len(want) and set(held) == want
    before = shuffled(spark)
    assert store.check().count() == 0
    assert shuffled(spark) - before < len(held)
    wrong = store.table("postings").filter("NOT (doc_id < 3 AND trigram = '日本😀')")
    twice = wrong.union(wrong.filter("doc_id = 9 AND trigram = 'ß日本'"))
    store.commit(whole={"postings": twice})
    expected = [("posting in vain", 9), *[("posting missing", i) for i in range(3)]]
    for few in (64, 1):
        monkeypatch.setattr("quarry.sources.store.FEW", few)
        assert sorted((r.problem, r.doc_id) for r in store.check().collect()) == expected


@pytest.mark.parametrize("size", [1, 20, 1 << 20])
def test_postings_of_a_group_are_in_order(monkeypatch, size):
    """Each trigram of a text once, by trigram and document, where texts are looked at in groups of any size."""
    texts = {5: "abcabc 日本日本日", 3: "bcabca", 8: "xyz", 4: "".join(map(chr, range(0x4E00, 0x5E00)))}
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(texts, pa.int64()), "line_start": pa.array([0] * 4, pa.int32()), "low": pa.array([t.encode() for t in texts.values()], pa.binary())})
    monkeypatch.setattr(postings, "GROUP_BYTES", size)
    monkeypatch.setattr(postings, "_KEYS", 1 << 37)
    runs = [[(r["trigram"], r["doc_id"]) for b in postings._distinct(g) for r in b.to_pylist()] for g in postings._groups(batch)]
    assert all(run == sorted(run) for run in runs if size == 1)
    assert sorted(sum(runs, [])) == sorted({(t[i : i + 3], k) for k, t in texts.items() for i in range(len(t) - 2)})


def shuffled(spark):
    """Bytes that all tasks so far have shuffled."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_a_store_without_kept_pending_chunks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert_documents(*rows_of(spark, range(3)))
    held = store.manifest()
    held["tables"].pop("pending")
    store._save(store._generation() + 1, held["tables"], held["gone"], {})
    assert store.vec_info().first().pending_count == 9 and store.pending().count() == 9
    assert store.check().count() == 0


def test_many_candidates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert_documents(*rows_of(spark, range(200)))
    assert [r.path for r in store.search_fts("license", 3).collect()] == [r.path for r in rank.fts_files(store.chunks(), "license", 3).collect()]
    bare = Store(spark, str(tmp_path / "bare"), indexed=False)
    bare.upsert_documents(*rows_of(spark, range(5)))
    assert "postings" not in bare.manifest()["tables"] and bare.search_fts("license").count() == 5


def bytes_read(spark):
    """Input of all tasks so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalInputBytes()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data here")
def test_a_search_reads_less_than_the_text(spark, tmp_path):
    """A phrase of few documents: the postings lead to them, and the same is found."""
    from quarry.plans import inputs

    store, sf = Store(spark, str(tmp_path / "s")), "/root/testdata/sf0.1"
    chunks = inputs.chunks(spark, sf)
    small = {"parquet.block.size": 1 << 20, "parquet.page.size": 64 << 10, "parquet.page.row.count.limit": 100}  # as the table is small, too
    for key, value in small.items():
        spark.conf.set(key, value)
    store.replace(documents=inputs.stored_files(spark, sf).select("id", "path"), chunks=chunks)
    for key in small:
        spark.conf.unset(key)
    phrase = chunks.select("doc_id", F.regexp_extract("text", "[0-9][0-9 .@-]{6,}[0-9]", 0).alias("p")).filter("p <> ''").orderBy("doc_id").first().p
    spent, found = [], []
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # else other threads read, which the figures lack
    for search in (lambda q: rank.fts_files(store.chunks(), q), lambda q: store.search_fts(q)):
        before = bytes_read(spark)
        found.append([(r.path, round(r.score, 9)) for r in search(f'"{phrase}"').collect()])
        spent.append(bytes_read(spark) - before)
    spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    assert found[0] == found[1] and found[0]
    assert spent[1] < spent[0] / 3, spent
