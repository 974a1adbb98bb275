"""The offline embedder where counts cancel, and its query on odd texts against its SQL."""

import duckdb
import numpy as np

from quarry.operators.embed import hash_embedder
from quarry.plans.queries import ORACLES, QUERIES


def test_only_the_empty_text_has_no_direction():
    texts = ["Öte.", "teie", "Heor", "thea", "", None, "a", "ordinary text"]  # the first four: two trigrams each, opposite signs in one place
    norms = np.linalg.norm(hash_embedder(32)(texts), axis=1)
    assert np.round(norms, 5).tolist() == [1, 1, 1, 1, 0, 1, 1, 1]
    assert np.round(np.linalg.norm(hash_embedder(1)(["aaaa", "abcd", "bcde", "cdef"]), axis=1), 5).tolist() == [1, 1, 1, 1]


def test_vectors_of_other_texts_stay_as_they_were():
    assert np.array_equal(hash_embedder(4)(["abcab", "Ab", "Ünï 漢😀"]).round(4), np.float32([[0, -1, 0, 0], [0, 1, 0, 0], [0, 0, 0.9487, -0.3162]]))


def test_query_on_odd_texts(spark, tmp_path):
    texts = ["Öte.", "teie", "", None, "plain text", "", None, "teie"]
    rows = [(n, t, "en", "web", len(t or "")) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0, 0.0]) for n in (5, 6, 7)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["emb1_embed_pending"](spark, str(tmp_path)).select("doc_id", "line_start", "text_hash", "dimension", "norm").collect()
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, line_start, text_hash, dimension, CAST(norm AS DOUBLE) FROM ({ORACLES['emb1_embed_pending']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 5
