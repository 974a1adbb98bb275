import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.operators import rank
from quarry.operators.match import MatchSyntaxError, occurrences, overlaps_itself, parse_match

TEXTS = [
    "hello world", "Hello there world hello", "the license of the world", "aaaa aaa", "CAFÉ noir", "cafe blanc", "nothing here",
    "hello", "world wide hello world", "the the the", "", "ab", "license: hello", "éclair license", "hello 'quoted' world",
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i // 2, i % 2, i % 2, t, f"/d/{i // 2}.md") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, line_start int, line_end int, text string, doc_path string")


@pytest.fixture(scope="module")
def sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='trigram')")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(TEXTS)))
    return con


@pytest.mark.parametrize(
    "query",
    ["hello", "hello world", '"hello world"', "hello OR license", "hello NOT world", "hel*", "text:hello", "ell", "ab", "hello ab", "ab hello", "cafe", "café", "aaa", "the",
     "(hello OR license) NOT world", "hello AND license", "hello OR ab", "hello NOT ab", "ab AND hello", "hello world NOT there OR the"],
)
def test_bm25_agrees_with_fts5(chunks, sqlite, query):
    want = {r: s for r, s in sqlite.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (query,))}
    got = {r.doc_id * 2 + r.line_start: r.score for r in rank.bm25(chunks, query).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("query", ["", "a-b", "(hello", "hello)", "OR hello", "hello NOT", '"open', "other:hello"])
def test_syntax_errors(sqlite, query):
    with pytest.raises(MatchSyntaxError):
        parse_match(query)
    with pytest.raises(sqlite3.OperationalError):
        sqlite.execute("SELECT rowid FROM f WHERE f MATCH ?", (query,)).fetchall()


def test_occurrences_overlap(spark):
    df = spark.createDataFrame([("aaaa",), ("xaxa.b",)], "t string")
    assert overlaps_itself("aa") and overlaps_itself("abab") and not overlaps_itself("license")
    assert [r[0] for r in df.select(occurrences(F.col("t"), "aa")).collect()] == [3, 0]
    assert [r[0] for r in df.select(occurrences(F.col("t"), "a.b")).collect()] == [0, 1]


def test_groups_ties_and_limits(chunks):
    files = rank.fts_files(chunks, "hello", limit=2).collect()
    assert len(files) == 2 and files[0].score <= files[1].score
    assert all(f.score == min(c.score for c in f.chunks) for f in files)
    assert rank.fts_files(chunks, "hello", limit=0).collect() == []
    tied = rank.fts_files(chunks.withColumn("text", F.lit("same hello")), "hello", limit=3).collect()
    assert [f.path for f in tied] == sorted(f.path for f in tied)
    assert [c.line_start for c in tied[0].chunks] == [0, 1]


def test_one_file_can_fill_the_overfetch(spark):
    rows = [(1, i, i, "hello", "/a") for i in range(20)] + [(2, 0, 0, "hello there, much longer text", "/b")]
    chunks = spark.createDataFrame(rows, "doc_id long, line_start int, line_end int, text string, doc_path string")
    assert [f.id for f in rank.fts_files(chunks, "hello", limit=2).collect()] == [1]
    assert [f.id for f in rank.fts_files(chunks, "hello", limit=2, overfetch=50).collect()] == [1, 2]


def test_prefix_is_literal(chunks):
    own = chunks.withColumn("doc_path", F.when(F.col("doc_id") == 0, "/a/bc/x").when(F.col("doc_id") == 1, "/a/%/x").otherwise(F.lit("/z")))
    assert {r.doc_path for r in rank.under_prefix(own, "/a/b").collect()} == {"/a/bc/x"}
    assert {r.doc_path for r in rank.under_prefix(own, "/a/%").collect()} == {"/a/%/x"}
    assert rank.under_prefix(own, "/a/*").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, line_start int, line_end int, text string, doc_path string, embedding array<float>")


def test_vectors(spark):
    rows = [(1, 0, 0, "a", "/a", [0.0, 0.0]), (2, 0, 0, "b", "/b", [3.0, 4.0]), (3, 0, 0, "c", "/c", [1.0]), (4, 0, 0, "d", "/b/d", [0.0, 1.0])]
    found = rank.vector_files(vectors(spark, rows), [0.0, 0.0]).collect()
    assert [(f.id, f.score) for f in found] == [(1, 0.0), (4, 1.0), (2, 5.0)]
    assert [f.id for f in rank.vector_files(vectors(spark, rows), [0.0, 0.0], limit=1, path_prefix="/b").collect()] == [4]


def test_large_dimension_takes_the_other_way(spark):
    from quarry.functions.vectors import UNROLLED

    n = UNROLLED + 10
    rows = [(1, 0, 0, "a", "/a", [1.0] * n), (2, 0, 0, "b", "/b", [0.0] * n), (3, 0, 0, "c", "/c", [1.0])]
    found = rank.vector_files(vectors(spark, rows), [0.0] * n).collect()
    assert [f.id for f in found] == [2, 1]
    assert found[1].score == pytest.approx(n**0.5)


def test_fusion(spark):
    kind = "id long, path string, score double, chunks array<struct<line_start:int,line_end:int,text:string,score:double>>"
    fts = spark.createDataFrame([(1, "/a", -2.0, [(0, 0, "x", -2.0)]), (2, "/b", -1.0, [(0, 0, "y", -1.0)])], kind)
    sem = spark.createDataFrame([(2, "/b", 0.1, [(0, 0, "y", 0.1), (5, 6, "z", 0.2)]), (3, "/c", 0.3, [(0, 0, "w", 0.3)])], kind)
    merged = rank.merge_ranked(fts, sem).collect()
    assert [(r.path, round(r.score, 9)) for r in merged] == [("/b", round(1 / 62 + 1 / 61, 9)), ("/a", round(1 / 61, 9)), ("/c", round(1 / 62, 9))]
    assert [(c.line_start, c.score, c.source) for c in merged[0].chunks] == [(0, -1.0, "fts"), (5, 0.2, "semantic")]
    halves = rank.merge_ranked(fts, sem, weight_fts=0.5, weight_semantic=0.5).collect()
    assert [r.path for r in halves] == [r.path for r in merged]
    assert [r.score * 2 for r in halves] == pytest.approx([r.score for r in merged])


def test_postings(chunks):
    from quarry.operators import postings

    for phrase in ("hello world", "café", "license"):
        want = {(r.doc_id, r.line_start) for r in chunks.filter(F.contains(F.lower("text"), F.lit(phrase))).collect()}
        got = {tuple(r) for r in postings.candidates(postings.trigrams(chunks), phrase).collect()}
        assert want <= got


def test_prefix_reaches_the_scan(spark, chunks, tmp_path):
    chunks.write.parquet(str(tmp_path / "c"))
    plan = rank.under_prefix(spark.read.parquet(str(tmp_path / "c")), "/d/1")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(doc_path,/d/1)" in plan
