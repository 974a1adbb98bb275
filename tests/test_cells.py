import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.vectors import l2_distance
from quarry.operators import cells, rank
from quarry.sources.store import Store


def clustered(spark, n=600, width=8, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (groups, width))
    rows = [(i, 0, 0, f"/ws/{'ab'[i % 2]}{i % groups}/{i}.md", f"text {i}", f"h{i}", (centres[i % groups] + rng.normal(0, 0.3, width)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, 0, 0, "/ws/none.md", "t", "h", None), (n + 1, 0, 0, "/ws/short.md", "t", "h", [1.0]), *[(n + 2 + i, 0, 0, f"/ws/a/twin{i}.md", "t", "h", rows[0][6]) for i in range(5)]]
    return spark.createDataFrame(rows, schemas.VECTORS), centres


def shown(df):
    return [(r.doc_id, r.doc_path, r.score) for r in df.collect()]


@pytest.mark.parametrize("n", [None, 1, 40])
def test_exact(spark, tmp_path, n):
    vectors, centres = clustered(spark)
    cells.write(vectors, str(tmp_path / "c"), 8, n)
    index = cells.Cells(spark, str(tmp_path / "c"), schemas.VECTORS)
    for query in (centres[0].tolist(), [0.0] * 8, (centres[3] * 0.5 + centres[4] * 0.5).tolist()):
        for k in (1, 6, 70, 1000):
            for prefix in (None, "/ws/a", "/ws/b3/", "/nowhere"):
                assert shown(index.nearest(query, k, prefix)) == shown(rank.nearest_chunks(vectors, query, k, prefix)), (k, prefix)


def test_few_cells_are_read(spark, tmp_path):
    vectors, centres = clustered(spark, 2000)
    cells.write(vectors, str(tmp_path / "c"), 8)
    index = cells.Cells(spark, str(tmp_path / "c"), schemas.VECTORS)
    found = index.nearest(centres[2].tolist(), 20)
    assert index.read.cells < 0.25 * index.read.of and index.read.rows < 0.25 * index.read.all_rows
    assert shown(found) == shown(rank.nearest_chunks(vectors, centres[2].tolist(), 20))
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().executedPlan().toString()


def test_no_vectors(spark, tmp_path):
    vectors, _ = clustered(spark, 20)
    cells.write(vectors.filter("doc_id < 0"), str(tmp_path / "c"), 8)
    assert cells.Cells(spark, str(tmp_path / "c"), schemas.VECTORS).nearest([0.0] * 8, 3).count() == 0


def test_in_a_store(spark, tmp_path):
    """Cells, vectors that came since, and vectors that went."""
    vectors, centres = clustered(spark)
    vectors = vectors.filter("size(embedding) = 8").withColumn("text_hash", F.sha2("text", 256))
    store, query = Store(spark, str(tmp_path / "s"), indexed=False), centres[1].tolist()
    store.ensure_dimension(8)
    chunks = vectors.select("doc_id", "line_start", "line_end", "text", "doc_path")
    store.replace(documents=vectors.select(F.col("doc_id").alias("id"), F.col("doc_path").alias("path")), chunks=chunks, chunk_vectors=vectors)
    store.build_cells()

    def check(read):
        assert shown(store.nearest_chunks(query, 9)) == shown(rank.nearest_chunks(store.vectors(), query, 9))
        assert (0 < store.read.cells < 0.5 * store.read.of) == read

    check(True)
    nearest = store.nearest_chunks(query, 3)
    store.remove_documents(nearest.select(F.col("doc_id").alias("id")))
    check(True)
    new = spark.createDataFrame([(9000, 0, 0, "/ws/new.md", "new", "", query)], schemas.VECTORS).withColumn("text_hash", F.sha2("text", 256))
    store.commit({"documents": spark.createDataFrame([(9000, "/ws/new.md")], schemas.DOCUMENTS), "chunks": new.select("doc_id", "line_start", "line_end", "text", "doc_path"), "chunk_vectors": new})
    check(True)
    assert store.nearest_chunks(query, 1).first().doc_id == 9000
    assert [r.path for r in store.search_similar(query, limit=1).collect()] == ["/ws/new.md"]
    store.compact()
    store.vacuum()
    store.read = cells.Read()
    check(False)
    store.build_cells()
    check(True)


def test_long_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 200).astype(np.float32).tolist()) for i in range(50)] + [(50, None), (51, [1.0])]
    query = rng.normal(0, 1, 200).tolist()
    got = {r.i: r.d for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", l2_distance(F.col("v"), query).alias("d")).collect()}
    q = np.float32(query).astype(float)
    for i, v in rows:
        assert got[i] is None if i >= 50 else abs(got[i] - np.sqrt(((np.array(v) - q) ** 2).sum())) < 1e-9
