"""One query per operator over the test tables, with equivalent SQL where there is one."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from itertools import count
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.config import Config
from quarry.functions import scalars
from quarry.functions.vectors import l2_between, l2_distance
from quarry.operators import cells, changes, chunk, chunkers, postings, rank
from quarry.operators.embed import Embedder, embed_pending, hash_embedder
from quarry.operators.match import parse_match
from quarry.plans import inputs
from quarry.sources import devices, files, indexer, tree
from quarry.sources.replicate import SharedFolder
from quarry.sources.store import Store
from quarry.streaming import debounce
from quarry.streaming.watch import apply_batch, index_stream, watch_tree
from quarry.workspace import RetrieveParams, Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TERMS = "license the"
NOW = datetime(2024, 6, 1, tzinfo=UTC)

# -- SQL parts

PATH = "'/ws/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md'"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CHUNKS = f"chunks AS (SELECT doc_id, CAST(0 AS INTEGER) AS line_start, CAST(0 AS INTEGER) AS line_end, text, {PATH} AS doc_path FROM documents)"
VECTORS = f"""vectors AS (SELECT d.doc_id, 0 AS line_start, {PATH.replace('doc_id', 'd.doc_id')} AS doc_path, d.text, e.embedding
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""
DISTANCE = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))))"
STORED = f"stored AS (SELECT {PATH} AS path, 1700000000 + doc_id AS mtime, n_chars AS length, doc_id AS id FROM documents)"
LISTED = "listed AS (SELECT path, mtime + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS mtime, length, id FROM stored WHERE id % 11 <> 0)"
NEW_CHUNKS = """new_chunks AS (
  SELECT doc_id, line_start, CASE WHEN doc_id % 3 = 0 THEN line_end + 1 ELSE line_end END AS line_end,
         CASE WHEN doc_id % 5 = 0 THEN text || ' (edited)' ELSE text END AS text, doc_path
  FROM chunks WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id, 2, 2, 'appended', doc_path FROM chunks WHERE doc_id % 17 = 0)"""
DEVICES = """records AS (
  SELECT 'dev-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS id, 'name ' || user_id AS name, 'host ' || user_id AS hostname, 'app' AS app_id, '1.0' AS app_version,
         'linux' AS platform, 'x86_64' AS arch, min(ts) AS registered_at, max(ts) AS updated_at, user_id AS n
  FROM events GROUP BY user_id)"""
CONTEXTS = """contexts AS (
  SELECT CASE WHEN n % 5 = 0 THEN 'new-' || id ELSE id END AS id, name || ' renamed' AS name, hostname, app_id, CASE WHEN n % 7 = 0 THEN '2.0' ELSE '1.0' END AS app_version, platform, arch,
         CASE WHEN n % 3 = 0 THEN NULL WHEN n % 2 = 0 THEN updated_at + INTERVAL 1 HOUR ELSE updated_at - INTERVAL 1 HOUR END AS updated_at
  FROM records)"""


def bm25_sql(phrases: list[str], condition: str = "", prefix: str = "", held: str = CHUNKS) -> str:
    """CTEs up to ``scored``; {i} in the condition stands for "has phrase i"."""
    has = [f"contains(lower(text), '{p}')" for p in phrases]
    counts = ", ".join(f"count(*) FILTER (WHERE {h}) AS n_{i}" for i, h in enumerate(has))
    terms = " + ".join(
        f"greatest(ln((n - n_{i} + 0.5) / (n_{i} + 0.5)), 1e-6) * f_{i} * 2.2 / (f_{i} + 1.2 * (0.25 + 0.75 * d / avg_d))" for i in range(len(phrases))
    )
    fs = ", ".join(f"CAST((length(text) - length(replace(lower(text), '{p}', ''))) / {len(p)} AS DOUBLE) AS f_{i}" for i, p in enumerate(phrases))
    where = (condition or " AND ".join("{%d}" % i for i in range(len(phrases)))).format(*has)
    under = f" AND starts_with(doc_path, '{prefix}')" if prefix else ""
    return f"""{held},
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(greatest(length(text) - 2, 0) AS DOUBLE)) AS avg_d, {counts} FROM chunks),
scored AS (SELECT doc_id, line_start, line_end, text, doc_path, -({terms}) AS score FROM (
  SELECT *, CAST(greatest(length(text) - 2, 0) AS DOUBLE) AS d, {fs} FROM chunks WHERE ({where}){under}) CROSS JOIN stats)"""


def files_sql(scored: str = "scored", chunks: int = 50, limit: int = 10, name: str = "grouped") -> str:
    return f"""{name}_top AS (SELECT * FROM {scored} ORDER BY score, doc_path, line_start LIMIT {chunks}),
{name} AS (SELECT doc_id AS id, doc_path AS path, min(score) AS score FROM {name}_top GROUP BY ALL ORDER BY score, path LIMIT {limit})"""


def fused_sql(k: float, wf: float, ws: float, limit: int) -> str:
    return f"""f AS (SELECT *, row_number() OVER (ORDER BY score, path) AS r FROM fts),
s AS (SELECT *, row_number() OVER (ORDER BY score, path) AS r FROM semantic)
SELECT coalesce(f.id, s.id) AS id, coalesce(f.path, s.path) AS path,
       round(coalesce({wf} / (f.r + {k}), 0) + coalesce({ws} / (s.r + {k}), 0), 9) AS score,
       CAST(1 AS BIGINT) AS hits
FROM f FULL JOIN s ON f.path = s.path
ORDER BY coalesce({wf} / (f.r + {k}), 0) + coalesce({ws} / (s.r + {k}), 0) DESC, path LIMIT {limit}"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- chunkers

CHK_PARTS = """parts AS (
  SELECT doc_id, """ + PATH + """ AS doc_path, unnest(p) AS part, generate_subscripts(p, 1) AS i
  FROM (SELECT *, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents)),
trimmed AS (SELECT *, """ + TRIM.format("part") + """ AS t,
  coalesce(sum(len(part) - len(replace(part, chr(10), '')) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + len(regexp_extract(part, '^\\s*')) - len(replace(regexp_extract(part, '^\\s*'), chr(10), '')) AS a FROM parts),
markdown AS (
  SELECT doc_id, CAST(a AS INTEGER) AS line_start, CAST(a + len(t) - len(replace(t, chr(10), '')) AS INTEGER) AS line_end, t AS text, doc_path FROM trimmed WHERE t <> ''
  UNION ALL SELECT doc_id, 0, 0, CAST(doc_id AS VARCHAR) || '.md', """ + PATH + """ FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM trimmed WHERE t <> ''))
"""


#: The paragraphs of all documents as chunks: many in a file.
PARAGRAPHS = f"{CHK_PARTS}, chunks AS (SELECT * FROM markdown)"


@query(
    "chk1_chunk_paragraphs",
    f"WITH {CHK_PARTS} SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS line_start, CAST(row_number() OVER w - 1 AS INTEGER) AS line_end, t AS text, doc_path "
    "FROM trimmed WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)",
)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_paragraphs(inputs.corpus(spark, sf_dir))


@query("chk2_chunk_markdown_lines", f"WITH {CHK_PARTS} SELECT * FROM markdown")
def chunk_markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_markdown(inputs.corpus(spark, sf_dir))


@query("win3_markdown_by_window", f"WITH {CHK_PARTS} SELECT * FROM markdown")
def chunk_markdown_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_markdown_by_window(inputs.corpus(spark, sf_dir))


@query(
    "chk3_chunk_jsonl",
    "SELECT conv_id AS doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS line_start, CAST(row_number() OVER w - 1 AS INTEGER) AS line_end, "
    + TRIM.format("replace(role || ': ' || text, chr(10) || chr(10), chr(10))")
    + " AS text, '/ws/logs/' || conv_id || '.jsonl' AS doc_path FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def chunk_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_jsonl(inputs.logs(spark, sf_dir))


@query(
    "sca1_message_text",
    "SELECT conv_id, turn, "
    + TRIM.format(
        """replace(CASE turn % 5 WHEN 0 THEN role || ': ' || text WHEN 1 THEN text WHEN 2 THEN role || ': ' || text
        WHEN 3 THEN 'extra: ' || text || chr(10) || 'kind: ' || role ELSE role || ' said' END, chr(10) || chr(10), chr(10))"""
    )
    + " AS text FROM conversations",
)
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in five shapes: usual, without role, number before text, without content, not JSON."""
    turns = inputs.table(spark, sf_dir, "conversations")
    line = (
        F.when(F.col("turn") % 5 == 0, F.to_json(F.struct("role", F.col("text").alias("content"))))
        .when(F.col("turn") % 5 == 1, F.to_json(F.struct(F.lit("").alias("name"), "role", F.col("text").alias("mes"))))
        .when(F.col("turn") % 5 == 2, F.to_json(F.struct(F.lit(7).alias("mes"), F.col("role").alias("speaker"), "text")))
        .when(F.col("turn") % 5 == 3, F.to_json(F.struct(F.col("role").alias("kind"), F.col("text").alias("extra"), F.lit(1).alias("n"))))
        .otherwise(F.concat("role", F.lit(" said")))
    )
    return turns.select("conv_id", "turn", scalars.message_text(line).alias("text"))


# -- scalars


@query(
    "sca6_doc_id_fnv1a",
    f"""SELECT path, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS id FROM (
  SELECT path, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(path, ''), lambda c: CAST(ord(c) AS HUGEINT))),
    lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS h
  FROM (SELECT {PATH} AS path FROM documents))""",
)
def doc_id_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.corpus(spark, sf_dir).select("path", scalars.fnv1a64(F.col("path")).alias("id"))


@query(
    "sca7_workspace_uuid",
    f"""SELECT path, h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-' || substr('89ab', CAST((strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1 AS INTEGER), 1) || h[18:20] || '-' || h[21:32] AS uuid
  FROM (SELECT {PATH} AS path, md5({PATH}) AS h FROM documents)""",
)
def workspace_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.corpus(spark, sf_dir).select("path", scalars.path_uuid(F.col("path")).alias("uuid"))


@query("sca8_l2_distance", f"SELECT a.vec_id, round({DISTANCE.format('a.embedding', 'b.embedding')}, 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.table(spark, sf_dir, "embeddings")
    return held.select("vec_id", F.round(l2_distance(F.col("embedding"), inputs.query_vector(spark, sf_dir)), 6).alias("distance"))


@query("sca8_l2_distance_long", f"SELECT a.vec_id, round(sqrt(2) * {DISTANCE.format('a.embedding', 'b.embedding')}, 5) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def distance_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors beyond the length up to which the distance is one expression: each embedding twice."""
    held = inputs.table(spark, sf_dir, "embeddings").withColumn("embedding", F.concat("embedding", "embedding"))
    return held.select("vec_id", F.round(l2_distance(F.col("embedding"), inputs.query_vector(spark, sf_dir) * 2), 5).alias("distance"))


@query("sca8_l2_between", f"SELECT a.vec_id, round({DISTANCE.format('a.embedding', 'b.embedding')}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distance_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(l2_between(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query(
    "sca12_extension_filter",
    r"""SELECT page_id, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\.([^.]*)$', 1)) AS extension,
       lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\.([^.]*)$', 1)) IN ('md', 'markdown', 'txt', 'rst', 'org', 'jsonl') AS indexed FROM pages""",
)
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "pages").select("page_id", scalars.extension(F.col("url")).alias("extension"), files.is_indexed(F.col("url")).alias("indexed"))


@query(
    "sca15_truncate_and_size",
    """SELECT doc_id, CASE WHEN length(text) > 20 THEN substr(text, 1, 19) || '…' ELSE text END AS short,
       CASE WHEN n_chars * 1000 >= 1073741824 THEN printf('%.1f GB', n_chars * 1000 / 1073741824.0) WHEN n_chars * 1000 >= 1048576 THEN printf('%.1f MB', n_chars * 1000 / 1048576.0)
            WHEN n_chars * 1000 >= 1024 THEN printf('%.1f KB', n_chars * 1000 / 1024.0) ELSE CAST(n_chars * 1000 AS VARCHAR) || ' B' END AS size FROM documents""",
)
def truncate_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", scalars.truncate(F.col("text"), 20).alias("short"), scalars.human_size(F.col("n_chars") * 1000).alias("size"))


@query("sca16_format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS shown FROM events")
def format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select("event_id", scalars.format_utc(F.col("ts")).alias("shown"))


@query("sca17_parse_float_array", "SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def parse_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scalars.parse_floats(F.to_json("embedding"))).alias("i", "value"))
    return held.withColumn("value", F.col("value").cast("double"))


@query(
    "sca18_ordered_embeddings",
    """SELECT vec_id, CAST(0 AS INTEGER) AS slot, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings
UNION ALL SELECT vec_id, CAST(2 AS INTEGER), CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER), CAST(unnest(list_reverse(embedding)) AS DOUBLE) FROM embeddings""",
)
def ordered_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer whose vectors come in the wrong order and that lacks one: slot 1 stays empty."""
    item = lambda i, v: F.struct(F.lit(i).alias("index"), v.alias("embedding"))
    data = F.array(item(2, F.reverse("embedding")), item(0, F.col("embedding"))).alias("data")
    held = inputs.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scalars.ordered_embeddings(F.to_json(F.struct(data)))).alias("slot", "v"))
    return held.select("vec_id", "slot", F.posexplode("v").alias("i", "value")).withColumn("value", F.col("value").cast("double"))


@query("src11_read_file_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS text FROM documents")
def read_file_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_range(inputs.table(spark, sf_dir, "documents").withColumnRenamed("text", "body"), 2, 4).select("doc_id", "text")


@query(
    "flt7_hidden_paths",
    """SELECT doc_id, doc_id % 4 IN (0, 1) AS hidden, doc_id % 4 = 0 AS in_hidden_directory FROM documents""",
)
def hidden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of path: hidden folder, hidden file, dots inside, plain."""
    n = F.col("doc_id") % 4
    path = F.when(n == 0, "a/.git/x.md").when(n == 1, "a/b/.x.md").when(n == 2, "a.b/c.d/x.md").otherwise("a/x.md")
    return inputs.table(spark, sf_dir, "documents").select("doc_id", scalars.hidden(path).alias("hidden"), scalars.in_hidden_directory(path).alias("in_hidden_directory"))


# -- full-text search


@query("agg6_corpus_stats", f"WITH {bm25_sql(['license', 'the'])} SELECT CAST(n AS BIGINT) AS n, round(avg_d, 6) AS avg_d, n_0, n_1 FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.corpus_stats(inputs.chunks(spark, sf_dir), parse_match(TERMS)).withColumn("avg_d", F.round("avg_d", 6))


@query("rnk1_fts_bm25_chunks", f"WITH {bm25_sql(['license', 'the'])} SELECT doc_id, line_start, doc_path, round(score, 6) AS score FROM scored")
def fts_bm25_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.bm25(inputs.chunks(spark, sf_dir), TERMS).select("doc_id", "line_start", "doc_path", F.round("score", 6).alias("score"))


@query("rnk1_fts_search_files", f"WITH {bm25_sql(['license', 'the'])}, {files_sql()} SELECT id, path, round(score, 6) AS score FROM grouped")
def fts_search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.fts_files(inputs.chunks(spark, sf_dir), TERMS).select("id", "path", F.round("score", 6).alias("score"))


@query("flt1_fts_search_prefix", f"WITH {bm25_sql(['license', 'the'], prefix='/ws/en/src1')}, {files_sql()} SELECT id, path, round(score, 6) AS score FROM grouped")
def fts_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the whole corpus, hits under a textual path prefix."""
    return rank.fts_files(inputs.chunks(spark, sf_dir), TERMS, path_prefix="/ws/en/src1").select("id", "path", F.round("score", 6).alias("score"))


@query(
    "flt6_fts_match_language",
    f"WITH {bm25_sql(['apache license', 'idiot', 'version'], '({0} OR {1}) AND NOT {2}')} SELECT doc_id, round(score, 6) AS score FROM scored",
)
def fts_match_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, OR, NOT, parentheses and a term that is too short to count."""
    return rank.bm25(inputs.chunks(spark, sf_dir), '("Apache License" OR idiot ab) NOT version').select("doc_id", F.round("score", 6).alias("score"))


@query("rnk1_fts_search_paragraph_files", f"WITH {bm25_sql(['the'], held=PARAGRAPHS)}, {files_sql()} SELECT id, path, round(score, 6) AS score FROM grouped")
def fts_search_paragraph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with several hits: fewer than the limit may be left of the chunks that are fetched."""
    return rank.fts_files(inputs.paragraphs(spark, sf_dir), "the").select("id", "path", F.round("score", 6).alias("score"))


@query(
    "agg4_group_by_file",
    f"""WITH {bm25_sql(['the'], prefix='/ws/en/src1', held=PARAGRAPHS)}, {files_sql()}
SELECT g.id, g.path, round(g.score, 6) AS file_score, t.line_start, t.line_end, t.text, round(t.score, 6) AS score FROM grouped g JOIN grouped_top t ON t.doc_id = g.id""",
)
def group_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rank.flat_hits(rank.fts_files(inputs.paragraphs(spark, sf_dir), "the", path_prefix="/ws/en/src1"))
    return hits.withColumn("file_score", F.round("file_score", 6)).withColumn("score", F.round("score", 6))


@query("rnk3_substring_files", f"SELECT doc_id AS id, {PATH} AS path, CAST(0 AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'license') ORDER BY path LIMIT 10")
def substring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.chunks(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_path").alias("path"), F.col("text").alias("body"))
    return rank.substring_files(docs, "LICENSE").select("id", "path", "score")


@query("mnt1_trigram_postings", "SELECT doc_id, CAST(0 AS INTEGER) AS line_start FROM documents WHERE contains(lower(text), 'apache license')")
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a phrase: all its trigrams by the postings table, then an exact check."""
    held = inputs.chunks(spark, sf_dir)
    found = held.join(postings.candidates(postings.trigrams(held), "Apache License"), ["doc_id", "line_start"], "left_semi")
    return found.filter(F.contains(F.lower("text"), F.lit("apache license"))).select("doc_id", "line_start")


# -- vector search


def _nearest_sql(prefix: str = "") -> str:
    under = f" WHERE starts_with(v.doc_path, '{prefix}')" if prefix else ""
    return f"""{VECTORS}, near AS (SELECT v.doc_id, v.line_start, v.doc_path, {DISTANCE.format('v.embedding', 'q.embedding')} AS score
  FROM vectors v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q{under})"""


@query("rnk4_vector_knn_chunks", f"WITH {_nearest_sql()} SELECT doc_id, line_start, doc_path, round(score, 6) AS score FROM near ORDER BY near.score, doc_path, line_start LIMIT 50")
def vector_knn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.nearest_chunks(inputs.vectors(spark, sf_dir), inputs.query_vector(spark, sf_dir), 50)
    return found.select("doc_id", "line_start", "doc_path", F.round("score", 6).alias("score"))


@query("rnk4_vector_search_files", f"WITH {_nearest_sql()}, {files_sql('near')} SELECT id, path, round(score, 6) AS score FROM grouped")
def vector_search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.vector_files(inputs.vectors(spark, sf_dir), inputs.query_vector(spark, sf_dir)).select("id", "path", F.round("score", 6).alias("score"))


@query("rnk5_vector_search_prefix", f"WITH {_nearest_sql('/ws/de')}, {files_sql('near')} SELECT id, path, round(score, 6) AS score FROM grouped")
def vector_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.vector_files(inputs.vectors(spark, sf_dir), inputs.query_vector(spark, sf_dir), path_prefix="/ws/de").select("id", "path", F.round("score", 6).alias("score"))


@query("rnk6_vector_search_without_vectors", "SELECT doc_id AS id, text AS path, CAST(0 AS DOUBLE) AS score FROM documents WHERE false")
def vector_search_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.no_files(inputs.chunks(spark, sf_dir)).select("id", "path", "score")


@query("rnk4_cells_nearest", ORACLES["rnk4_vector_knn_chunks"])
def cells_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks from vectors in cells, of which only those that can hold one are read."""
    found = _cells(spark, sf_dir).nearest(inputs.query_vector(spark, sf_dir), 50)
    return found.select("doc_id", "line_start", "doc_path", F.round("score", 6).alias("score"))


@query("rnk5_cells_prefix", ORACLES["rnk5_vector_search_prefix"])
def cells_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _cells(spark, sf_dir).nearest(inputs.query_vector(spark, sf_dir), 50, "/ws/de")
    return rank.group_by_file(near, 10).select("id", "path", F.round("score", 6).alias("score"))


def _cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    path = f"{_scratch(spark)}/cells"
    cells.write(inputs.vectors(spark, sf_dir), path, 64)
    return cells.Cells(spark, path, schemas.VECTORS)


# -- hybrid


def _hybrid_sql(wf: float, ws: float) -> str:
    return (
        f"WITH {bm25_sql(['license', 'the'])}, {_nearest_sql()}, {files_sql('scored', 150, 30, 'fts')}, {files_sql('near', 150, 30, 'semantic')}, " + fused_sql(60.0, wf, ws, 10)
    )


def _fused(df: DataFrame) -> DataFrame:
    return df.select("id", "path", F.round("score", 9).alias("score"), F.size("chunks").cast("bigint").alias("hits"))


@query("rnk7_hybrid_rrf", _hybrid_sql(1.0, 1.0))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(rank.hybrid_files(inputs.chunks(spark, sf_dir), inputs.vectors(spark, sf_dir), TERMS, inputs.query_vector(spark, sf_dir)))


@query("rnk8_rrf_weighted", _hybrid_sql(0.7, 0.3))
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = inputs.query_vector(spark, sf_dir)
    return _fused(rank.hybrid_files(inputs.chunks(spark, sf_dir), inputs.vectors(spark, sf_dir), TERMS, q, weight_fts=0.7, weight_semantic=0.3))


@query("rnk9_retrieve_default_weights", _hybrid_sql(0.5, 0.5))
def retrieve_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace's search with its configured weights; its embedder gives the query's vector."""
    q = inputs.query_vector(spark, sf_dir)
    root = tree.local(_scratch(spark))
    os.makedirs(root, exist_ok=True)

    class Known(Workspace):
        embedder = Embedder(lambda texts: [q for _ in texts], len(q))

    workspace = Known(spark, root, Config.load({"embedding": {"enabled": True, "dimension": len(q)}}, {}))
    workspace.store.ensure_dimension(len(q))
    held = inputs.stored_files(spark, sf_dir)
    workspace.store.replace(documents=held.select("id", "path"), chunks=inputs.chunks(spark, sf_dir), chunk_vectors=inputs.vectors(spark, sf_dir))
    return _fused(workspace.retrieve(RetrieveParams(TERMS)))


@query("rnk7_hybrid_fts_only", f"WITH {bm25_sql(['license', 'the'])}, {files_sql('scored', 150, 10)} SELECT id, path, round(score, 6) AS score FROM grouped")
def hybrid_fts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an embedder: plain full-text files with their raw scores."""
    return rank.hybrid_files(inputs.chunks(spark, sf_dir), None, TERMS, None).select("id", "path", F.round("score", 6).alias("score"))


# -- changes


@query("dml1_upsert_files", f"WITH {STORED}, {LISTED} SELECT path, mtime, length FROM stored WHERE path NOT IN (SELECT path FROM listed WHERE id % 7 = 0) UNION ALL SELECT path, mtime, length FROM listed WHERE id % 7 = 0")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, listed = inputs.stored_files(spark, sf_dir), inputs.listed_files(spark, sf_dir)
    return changes.upsert(held.drop("id"), changes.changed_files(listed, held), ["path"])


@query("dml2_remove_files", f"WITH {STORED} SELECT path, mtime, length FROM stored WHERE id % 11 <> 0")
def remove_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.stored_files(spark, sf_dir)
    return changes.remove(held, changes.difference(held, inputs.listed_files(spark, sf_dir), "path"), ["path"]).drop("id")


@query("dml4_replace_document_chunks", f"WITH {CHUNKS}, {NEW_CHUNKS} SELECT doc_id, line_start, line_end, text FROM new_chunks UNION ALL SELECT doc_id, line_start, line_end, text FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM new_chunks)")
def replace_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = inputs.changed_chunks(spark, sf_dir)
    return changes.replace_children(old, new, "doc_id").select("doc_id", "line_start", "line_end", "text")


@query(
    "dml5_chunk_diff",
    f"""WITH {CHUNKS}, {NEW_CHUNKS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CAST(coalesce(o.line_start, n.line_start) AS INTEGER) AS line_start,
  CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.text <> n.text THEN 'update_text' WHEN o.line_end <> n.line_end THEN 'update_range' ELSE 'keep' END AS action
  FROM chunks o FULL JOIN new_chunks n ON o.doc_id = n.doc_id AND o.line_start = n.line_start""",
)
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.chunk_diff(*inputs.changed_chunks(spark, sf_dir))


def _filled(spark: SparkSession, sf_dir: str, **tables: DataFrame) -> Store:
    """A store with the tables' documents, files and chunks."""
    store = Store(spark, f"{_scratch(spark)}/store")
    held = inputs.stored_files(spark, sf_dir)
    store.replace(**{"documents": held.select("id", "path"), "files": held.drop("id"), "chunks": inputs.chunks(spark, sf_dir)} | tables)
    return store


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


@query(
    "dml6_remove_documents",
    f"""WITH {CHUNKS}, {VECTORS}, left_over AS (SELECT * FROM documents WHERE doc_id % 11 <> 0)
SELECT 'documents' AS name, count(*) AS n FROM left_over UNION ALL SELECT 'files', count(*) FROM left_over UNION ALL SELECT 'chunks', count(*) FROM left_over
UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE doc_id % 11 <> 0
UNION ALL SELECT 'pending', count(*) FROM left_over WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'postings', CAST(sum(len(list_distinct(list_transform(generate_series(1, length(text) - 2), lambda i: substr(lower(text), i, 3))))) AS BIGINT) FROM left_over WHERE length(text) >= 3
UNION ALL SELECT 'problems', 0""",
)
def remove_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 11th document is removed from a store with all that belongs to it; what each table holds then, and what the tables disagree on."""
    store = _filled(spark, sf_dir, chunk_vectors=inputs.vectors(spark, sf_dir))
    store.remove_documents(changes.difference(inputs.stored_files(spark, sf_dir), inputs.listed_files(spark, sf_dir), "id"))
    return _counts({
        "documents": store.documents(), "files": store.files(), "chunks": store.chunks(), "vectors": store.vectors(), "pending": store.table("pending"),
        "postings": store.table("postings"), "problems": store.check(),
    })


@query(
    "dml7_insert_embeddings",
    """SELECT doc_id, CAST(0 AS INTEGER) AS line_start, sha256(text) AS text_hash, CAST(32 AS INTEGER) AS dimension, CAST(0 AS BIGINT) AS pending_left FROM documents WHERE text IS NOT NULL""",
)
def insert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store embeds its chunks: what it keeps of each vector, and how many chunks still wait."""
    store = _filled(spark, sf_dir)
    store.embed_pending(hash_embedder(32))
    left = store.table("pending").agg(F.count("*").alias("pending_left"))
    return store.vectors().select("doc_id", "line_start", "text_hash", F.size("embedding").alias("dimension")).crossJoin(left)  # one row


@query("joi3_embedded_keys", f"WITH {VECTORS} SELECT doc_id, CAST(line_start AS INTEGER) AS line_start FROM vectors")
def embedded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.embedded(inputs.chunks(spark, sf_dir), inputs.vectors(spark, sf_dir))


@query("joi4_pending_chunks", f"WITH {CHUNKS}, {NEW_CHUNKS} SELECT doc_id, CAST(line_start AS INTEGER) AS line_start FROM new_chunks WHERE NOT (line_start = 0 AND doc_id % 5 <> 0 AND doc_id IN (SELECT vec_id FROM embeddings))")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.pending(inputs.changed_chunks(spark, sf_dir)[1], inputs.vectors(spark, sf_dir)).select("doc_id", "line_start")


@query("joi5_removed_documents", "SELECT doc_id AS id FROM documents WHERE doc_id % 11 = 0")
def removed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.difference(inputs.stored_files(spark, sf_dir), inputs.listed_files(spark, sf_dir), "id")


@query("joi6_mtime_changed", f"WITH {STORED}, {LISTED} SELECT path, mtime FROM listed WHERE id % 7 = 0")
def mtime_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed_files(inputs.listed_files(spark, sf_dir), inputs.stored_files(spark, sf_dir)).select("path", "mtime")


@query("agg1_file_count", "SELECT count(*) AS n FROM documents")
def file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.stored_files(spark, sf_dir).agg(F.count("*").alias("n"))


@query("agg2_document_count", "SELECT count(*) AS n FROM documents")
def document_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.corpus(spark, sf_dir).agg(F.count("*").alias("n"))


@query(
    "agg3_vec_info",
    f"""WITH {VECTORS} SELECT CAST(64 AS INTEGER) AS embedding_dim, (SELECT count(*) FROM vectors) AS vector_count,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending_count""",
)
def vec_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.vectors(spark, sf_dir)
    counts = held.agg(F.max(F.size("embedding")).alias("embedding_dim"), F.count("*").alias("vector_count"))
    return counts.crossJoin(changes.pending(inputs.chunks(spark, sf_dir), held).agg(F.count("*").alias("pending_count")))


@query(
    "agg9_sync_counters",
    f"""WITH {CHUNKS}, {NEW_CHUNKS}, acts AS (SELECT CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.text <> n.text THEN 'update_text'
  WHEN o.line_end <> n.line_end THEN 'update_range' ELSE 'keep' END AS action FROM chunks o FULL JOIN new_chunks n ON o.doc_id = n.doc_id AND o.line_start = n.line_start)
  SELECT action, count(*) AS n FROM acts GROUP BY action""",
)
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a store's commit returns for documents that are written again."""
    old, new = inputs.changed_chunks(spark, sf_dir)
    store = _filled(spark, sf_dir, chunks=old)
    held = inputs.stored_files(spark, sf_dir).select("id", "path")
    actions = store.upsert_documents(held, new)
    return spark.createDataFrame([(k, n) for k, n in actions.items()], "action string, n bigint")  # as many rows as actions


@query("agg8_folder_size", "SELECT '/ws/' || lang || '/' || source AS folder, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY ALL")
def folder_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.folder_sizes(inputs.stored_files(spark, sf_dir)).select("folder", "size")


# -- devices


@query(
    "dml9_device_merge",
    f"""WITH {DEVICES}, {CONTEXTS}, both_sides AS (
  SELECT coalesce(r.id, c.id) AS id, r.id IS NULL AS is_new, c.id IS NULL AS silent, coalesce(c.updated_at > r.updated_at, false) AS newer, r.name AS r_name, c.name AS c_name,
    r.app_version AS r_version, c.app_version AS c_version, r.registered_at, r.updated_at AS r_time, coalesce(c.updated_at, TIMESTAMP '2024-06-01 00:00:00') AS c_time
  FROM records r FULL JOIN contexts c ON r.id = c.id)
  SELECT id, CASE WHEN is_new THEN c_name WHEN silent OR NOT newer THEN r_name ELSE c_name END AS name, CASE WHEN silent THEN r_version ELSE c_version END AS app_version,
    strftime(CASE WHEN is_new THEN c_time ELSE registered_at END, '%Y-%m-%d %H:%M:%SZ') AS registered,
    strftime(CASE WHEN is_new THEN c_time WHEN silent OR NOT newer THEN r_time ELSE c_time END, '%Y-%m-%d %H:%M:%SZ') AS updated,
    CASE WHEN is_new THEN true WHEN silent THEN false ELSE newer OR r_version <> c_version END AS changed FROM both_sides""",
)
def device_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = devices.merge_contexts(inputs.device_records(spark, sf_dir), inputs.device_contexts(spark, sf_dir), NOW)
    return merged.select("id", "name", "app_version", scalars.format_utc(F.col("registered_at")).alias("registered"), scalars.format_utc(F.col("updated_at")).alias("updated"), "changed")


@query("dml10_device_set_name", f"WITH {DEVICES} SELECT id, CASE WHEN n = (SELECT min(user_id) FROM events) THEN 'chosen' ELSE name END AS name FROM records")
def device_set_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.device_records(spark, sf_dir)
    first = held.agg(F.min("id")).first()[0]
    return devices.set_name(held, first, "chosen", NOW).select("id", "name")


@query(
    "dml11_device_update_if_newer",
    f"""WITH {DEVICES}, {CONTEXTS}, incoming AS (SELECT id, name, updated_at FROM contexts WHERE updated_at IS NOT NULL)
  SELECT coalesce(r.id, i.id) AS id, CASE WHEN r.id IS NULL OR i.updated_at > r.updated_at THEN i.name ELSE r.name END AS name FROM records r FULL JOIN incoming i ON r.id = i.id""",
)
def device_update_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = inputs.device_contexts(spark, sf_dir).filter(F.col("updated_at").isNotNull()).withColumn("registered_at", F.col("updated_at"))
    return devices.update_if_newer(inputs.device_records(spark, sf_dir), incoming).select("id", "name")


@query(
    "dml16_newest_side_wins",
    "SELECT user_id, max(event_id) AS event_id FROM events e WHERE ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id) GROUP BY user_id",
)
def newest_side_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key the newer of two sides; ours (the larger event numbers) wins ties."""
    rows = inputs.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    latest = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("ts"))
    earliest = rows.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("ts"))
    return changes.newest(latest, earliest, "user_id", "ts").select("user_id", "event_id")


@query("win2_device_numbers", f"WITH {DEVICES} SELECT id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS number FROM records")
def device_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.numbered(inputs.device_records(spark, sf_dir)).select("id", "number")


@query("joi11_device_by_number", f"WITH {DEVICES} SELECT id, name FROM records ORDER BY id LIMIT 1 OFFSET 2")
def device_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.find(inputs.device_records(spark, sf_dir), "3").select("id", "name")


@query("prj3_device_table", f"""WITH {DEVICES} SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS number, name, hostname, platform, app_version, strftime(updated_at, '%Y-%m-%d %H:%M:%SZ') AS updated_at FROM records""")
def device_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.shown(inputs.device_records(spark, sf_dir))


@query("src7_device_registry_lines", f"WITH {DEVICES} SELECT id, name, strftime(updated_at, '%Y-%m-%d %H:%M:%SZ') AS updated FROM records")
def device_registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices written as JSON lines and parsed again."""
    lines = devices.to_lines(inputs.device_records(spark, sf_dir)).withColumn("line", F.lit(1))
    return devices.parse(lines).select("id", "name", scalars.format_utc(F.col("updated_at")).alias("updated"))


# -- embedding and streaming


@query(
    "emb1_embed_pending",
    """SELECT doc_id, CAST(0 AS INTEGER) AS line_start, sha256(text) AS text_hash, CAST(32 AS INTEGER) AS dimension, CASE WHEN text = '' THEN 0.0 ELSE 1.0 END AS norm
FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline embedder over all chunks without a vector: keys, sizes and lengths of the new vectors."""
    found = embed_pending(inputs.chunks(spark, sf_dir), inputs.vectors(spark, sf_dir), hash_embedder(32))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return found.select("doc_id", "line_start", "text_hash", F.size("embedding").alias("dimension"), F.round(F.sqrt(square), 5).alias("norm"))


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share; a local one where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="quarry-")


@query(
    "str5_stream_index_append",
    """WITH logs AS (SELECT conv_id, CAST(row_number() OVER w - 1 AS INTEGER) AS line, turn, count(*) OVER (PARTITION BY conv_id) AS n,
  """
    + TRIM.format("replace(role || ': ' || text, chr(10) || chr(10), chr(10))")
    + """ AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT '/ws/logs/' || conv_id || '.jsonl' AS doc_path, line AS line_start, text, line < (n + 1) // 2 AS embedded FROM logs""",
)
def stream_index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs arrive half written, are embedded, and arrive whole: lines that were there keep their vectors."""
    folder, logs = _scratch(spark), inputs.logs(spark, sf_dir)
    store = Store(spark, f"{folder}/store")
    lines = F.split("body", "\n")
    half = F.array_join(F.slice(lines, F.lit(1), F.ceil(F.size(lines) / 2).cast("int")), "\n")
    for time, body in ((1, half), (2, F.col("body"))):
        rows = logs.select("path", F.lit(time).cast("bigint").alias("mtime"), F.length(body).cast("bigint").alias("length"), body.alias("body"))
        rows.write.mode("append").parquet(f"{folder}/arrivals")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/arrivals")
        run = arriving.writeStream.foreachBatch(lambda batch, n: apply_batch(store, batch, number=("logs", n))).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
        if time == 1:
            store.embed_pending(hash_embedder(16))
    vectors = store.vectors().select("doc_id", "line_start", F.lit(True).alias("own"))
    return store.chunks().join(vectors, ["doc_id", "line_start"], "left").select("doc_path", "line_start", "text", F.coalesce("own", F.lit(False)).alias("embedded"))


def _written(rows: DataFrame, root: str) -> None:
    """Write rows (path below the root, body) as files, on the executors."""
    arrow = pa.schema([("n", pa.int64())])

    def write(batches):
        made = set()
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = os.path.join(root, path)
                if (folder := os.path.dirname(full)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                Path(full).write_bytes(body if isinstance(body, bytes) else (body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], schema=arrow)

    os.makedirs(root, exist_ok=True)
    rows.select("path", "body").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _removed(rows: DataFrame, root: str) -> None:
    """Delete the files of rows (path), on the executors."""

    def remove(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                os.remove(os.path.join(root, path))
            yield batch

    rows.select("path").mapInArrow(remove, "path string").count()


_TREE = "lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md'"


@query(
    "str3_stream_changes_and_deletes",
    f"""WITH states AS (SELECT *, doc_id % 11 = 0 AS gone, doc_id % 7 = 0 AS touched FROM documents)
SELECT {_TREE} AS path, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS n, CASE WHEN touched THEN 'touched' ELSE coalesce(nullif({TRIM.format("regexp_replace(text, chr(10) || '+', ' ', 'g')")}, ''), CAST(doc_id AS VARCHAR) || '.md') END AS text FROM states WHERE NOT gone""",
)
def stream_changes_and_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree of files that a stream follows over a restart: some are written again, some go."""
    folder = tree.local(_scratch(spark))
    root = f"{folder}/tree"
    os.makedirs(root)
    docs = inputs.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.regexp_replace("text", "\n+", " ").alias("body"))
    store = Store(spark, f"{folder}/store", indexed=False)
    _written(rows, root)
    index_stream(spark, store, root, f"{folder}/progress", once=True).awaitTermination()
    _written(rows.filter("doc_id % 7 = 0").withColumn("body", F.lit("touched")), root)
    _removed(rows.filter("doc_id % 11 = 0"), root)
    for _ in range(2):  # the second time nothing is left to do
        index_stream(spark, store, root, f"{folder}/progress", once=True).awaitTermination()
    start = len(root) + 2
    return store.chunks().groupBy("doc_path").agg(F.count("*").alias("n"), F.first("text").alias("text")).select(F.expr(f"substring(doc_path, {start})").alias("path"), "n", "text")


@query(
    "src1_sync_tree",
    f"""WITH states AS (SELECT *, doc_id % 11 = 0 AS gone, doc_id % 7 = 0 AS touched FROM documents)
SELECT * FROM (VALUES ('full', (SELECT count(*) FROM states), CAST(0 AS BIGINT)), ('again', CAST(0 AS BIGINT), CAST(0 AS BIGINT)),
  ('changed', (SELECT count(*) FROM states WHERE touched AND NOT gone), (SELECT count(*) FROM states WHERE gone))) AS t(step, written, removed)""",
)
def sync_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full sync of a tree that the executors list, one without changes, and one after changes."""
    root = f"{tree.local(_scratch(spark))}/tree"
    os.makedirs(root)
    rows = inputs.table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("body"))
    store = Store(spark, f"{_scratch(spark)}/store", indexed=False)
    _written(rows, root)
    steps = [("full", *indexer.sync(spark, store, root)), ("again", *indexer.sync_incremental(spark, store, root))]
    _written(rows.filter("doc_id % 7 = 0").withColumn("body", F.lit("touched")), root)
    _removed(rows.filter("doc_id % 11 = 0"), root)
    steps.append(("changed", *indexer.sync_incremental(spark, store, root)))
    return spark.createDataFrame(steps, "step string, written bigint, removed bigint")


# -- smaller parts, one by one


@query("sca2_normalise", "SELECT doc_id, " + TRIM.format("replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), chr(10) || chr(10), chr(10))") + " AS text FROM documents")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three line ends become two: the collapse runs once."""
    tripled = F.replace("text", F.lit("\n"), F.lit("\n\n\n"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", scalars.normalise(tripled).alias("text"))


@query("sca3_count_newlines", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n FROM documents")
def count_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", scalars.count_newlines(F.col("text")).alias("n"))


@query("sca4_trim_unicode", "SELECT doc_id, " + TRIM.format("text") + " AS text FROM documents")
def trim_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space that a plain trim leaves: no-break and ideographic spaces, line separators."""
    padded = F.concat(F.lit(" 　 \t"), "text", F.lit(" \r\n "))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", scalars.trim_unicode(padded).alias("text"))


@query("win4_line_numbers", "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a final line end added, which adds no line."""
    ended = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\n"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(scalars.lines(ended)).alias("line", "text"))


@query("flt5_substring_any_case", "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
def substring_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lower(F.lit("Apache LICENSE")))).select("doc_id")


@query("flt2_path_prefix", f"WITH {CHUNKS} SELECT doc_id, doc_path FROM chunks WHERE starts_with(doc_path, '/ws/fr/src1')")
def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.under_prefix(inputs.chunks(spark, sf_dir), "/ws/fr/src1").select("doc_id", "doc_path")


@query("flt11_point_lookup", f"WITH {CHUNKS} SELECT doc_id, doc_path FROM chunks WHERE doc_id = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.chunks(spark, sf_dir).filter("doc_id = 7").select("doc_id", "doc_path")


@query("joi1_hits_with_documents", f"WITH {bm25_sql(['license'])} SELECT s.doc_id, {PATH.replace('doc_id', 'd.doc_id')} AS path, d.n_chars, round(s.score, 6) AS score FROM scored s JOIN documents d ON d.doc_id = s.doc_id")
def hits_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a search with their documents' rows."""
    hits = rank.bm25(inputs.chunks(spark, sf_dir), "license").select("doc_id", "score")
    held = inputs.stored_files(spark, sf_dir).select("id", "path", F.col("length").alias("n_chars"))
    return changes.with_documents(hits, held).select("doc_id", "path", "n_chars", F.round("score", 6).alias("score"))


@query("joi2_vectors_with_documents", f"WITH {VECTORS} SELECT v.doc_id, v.doc_path, d.n_chars FROM vectors v JOIN documents d ON d.doc_id = v.doc_id")
def vectors_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.stored_files(spark, sf_dir).select("id", F.col("length").alias("n_chars"))
    return changes.with_documents(inputs.vectors(spark, sf_dir), held).select("doc_id", "doc_path", "n_chars")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two short result lists that share files: by words and by distance."""
    return rank.fts_files(inputs.chunks(spark, sf_dir), "the", limit=20), rank.vector_files(inputs.vectors(spark, sf_dir), inputs.query_vector(spark, sf_dir), limit=20)


_LISTS = f"{bm25_sql(['the'])}, {files_sql('scored', 100, 20, 'fts')}, {_nearest_sql()}, {files_sql('near', 100, 20, 'semantic')}"


@query("joi7_rrf_full_join", f"WITH {_LISTS}, " + fused_sql(60.0, 1.0, 1.0, 40).replace("CAST(1 AS BIGINT) AS hits", "f.id IS NOT NULL AND s.id IS NOT NULL AS in_both"))
def rrf_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of lists of which each has files of its own."""
    fts, near = _lists(spark, sf_dir)
    merged = rank.merge_ranked(fts, near, limit=40)
    both = fts.select("path").join(near.select("path"), "path").withColumn("in_both", F.lit(True))
    return merged.join(both, "path", "left").select("id", "path", F.round("score", 9).alias("score"), F.coalesce("in_both", F.lit(False)).alias("in_both"))


@query(
    "joi8_merge_hits",
    f"""WITH {bm25_sql(['the'], held=PARAGRAPHS)}, {files_sql('scored', 100, 20, 'fts')}, near AS (SELECT *, CAST(abs(length(text) - 40) AS DOUBLE) AS score FROM chunks WHERE contains(lower(text), 'the')),
{files_sql('near', 100, 20, 'semantic')},
f AS (SELECT t.doc_id AS id, t.line_start, t.line_end FROM fts_top t JOIN fts g ON g.id = t.doc_id), s AS (SELECT t.doc_id AS id, t.line_start, t.line_end FROM semantic_top t JOIN semantic g ON g.id = t.doc_id)
SELECT id, line_start, 'fts' AS source FROM f
UNION ALL SELECT id, line_start, 'semantic' FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = s.id AND f.line_start = s.line_start AND f.line_end = s.line_end)""",
)
def merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with several hits in each list; a hit of both lists is kept once, as the full-text hit."""
    held = inputs.paragraphs(spark, sf_dir)
    score = F.abs(F.length("text") - 40).cast("double")
    near = rank.group_by_file(rank.best(held.filter(F.contains(F.lower("text"), F.lit("the"))).withColumn("score", score), 100), 20)
    merged = rank.merge_ranked(rank.fts_files(held, "the", limit=20), near, limit=40)
    return merged.select("id", F.explode("chunks").alias("c")).select("id", "c.line_start", "c.source")


@query("win1_rank_positions", f"WITH {bm25_sql(['license', 'the'])}, {files_sql()} SELECT id, CAST(row_number() OVER (ORDER BY score, path) AS INTEGER) AS rank FROM grouped")
def rank_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return rank.fts_files(inputs.chunks(spark, sf_dir), TERMS).select("id", F.row_number().over(Window.orderBy("score", "path")).alias("rank"))


@query("lim1_best_chunks", f"WITH {bm25_sql(['the'])} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score, doc_path, line_start LIMIT 25")
def best_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.fts_chunks(inputs.chunks(spark, sf_dir), "the", limit=5).select("doc_id", F.round("score", 6).alias("score"))


@query("set1_key_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return changes.difference(inputs.chunks(spark, sf_dir), held, "doc_id")


@query("agg7_db_info", f"WITH {VECTORS} SELECT CAST(4 AS INTEGER) AS schema_version, (SELECT count(*) FROM documents) AS document_count, CAST(64 AS INTEGER) AS embedding_dim, (SELECT count(*) FROM vectors) AS vector_count, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending_count")
def db_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store filled from the tables reports about itself."""
    store = Store(spark, f"{_scratch(spark)}/store")
    store.ensure_dimension(64)
    held = inputs.stored_files(spark, sf_dir)
    store.replace(documents=held.select("id", "path"), files=held.drop("id"), chunks=inputs.chunks(spark, sf_dir), chunk_vectors=inputs.vectors(spark, sf_dir))
    return store.info().drop("db_path")


@query("agg10_stored_times", f"WITH {STORED} SELECT path, mtime FROM stored")
def stored_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store remembers of the files."""
    return _filled(spark, sf_dir).files().select("path", "mtime")


@query(
    "dml3_store_upsert_documents",
    f"""WITH {CHUNKS}, {NEW_CHUNKS} SELECT doc_id, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, text,
  line_start = 0 AND doc_id IN (SELECT vec_id FROM embeddings) AND doc_id % 5 <> 0 AS embedded FROM new_chunks
  UNION ALL SELECT doc_id, line_start, line_end, text, doc_id IN (SELECT vec_id FROM embeddings) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM new_chunks)""",
)
def store_upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written again: changed chunks lose their vector, unchanged ones keep it."""
    store = Store(spark, f"{_scratch(spark)}/store")
    old, new = inputs.changed_chunks(spark, sf_dir)
    held = inputs.stored_files(spark, sf_dir).select("id", "path")
    store.replace(documents=held, chunks=old, chunk_vectors=inputs.vectors(spark, sf_dir))
    store.upsert_documents(held.join(new.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi"), new)
    vectors = store.vectors().select("doc_id", "line_start", F.lit(True).alias("own"))
    return store.chunks().join(vectors, ["doc_id", "line_start"], "left").select("doc_id", "line_start", "line_end", "text", F.coalesce("own", F.lit(False)).alias("embedded"))


@query(
    "dml12_name_if_newer",
    f"""WITH {DEVICES}, {CONTEXTS} SELECT r.id, CASE WHEN c.updated_at > r.updated_at THEN c.name ELSE r.name END AS name FROM records r JOIN contexts c ON c.id = r.id""",
)
def name_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's own name register takes a newer name; a null time is the oldest."""
    return devices.newer_names(inputs.device_records(spark, sf_dir), inputs.device_contexts(spark, sf_dir))


@query("dml8_registry_lines_sorted", f"WITH {DEVICES} SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS line, id FROM records")
def registry_lines_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry file's lines, in order of ids."""
    folder = tree.local(_scratch(spark))
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/devices.jsonl"
    devices.save(inputs.device_records(spark, sf_dir), path)
    with open(path, encoding="utf-8") as file:
        rows = [(i, devices.record(x)["id"]) for i, x in enumerate(file, 1)]
    return spark.createDataFrame(rows, "line int, id string")


def _slices(rows: DataFrame, time: Column, n: int) -> list[DataFrame]:
    """Rows in ``n`` parts, in the order of ``time``."""
    first, last = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    if first is None:
        return []
    width = (last - first) // n + 1
    return [rows.filter(F.floor((F.unix_micros(time) - first) / width) == i) for i in range(n)]


@query(
    "str2_debounced_events",
    """WITH cut AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR, true) AS fresh FROM events),
bursts AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM cut),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, burst ORDER BY ts DESC, event_id DESC) AS n FROM bursts)
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS events_until FROM placed WHERE n = 1""",
)
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream in four batches, every tenth one 12 hours late: the last event of each burst of a user.

    The stream starts again for each batch, and goes on with the bursts that its
    checkpoint holds. A last event of nobody's, a month later, moves the watermark past
    all bursts.
    """
    folder = _scratch(spark)
    rows = inputs.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"))
    late = F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    nobody = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"))
    held = spark.conf.get(debounce.PROVIDER)
    debounce.use_rocksdb(spark)
    try:
        for part in (*_slices(rows, F.col("ts") + late, 4), nobody):
            part.write.mode("append").parquet(f"{folder}/events")
            arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/events")
            bursts = debounce.debounce(arriving, "user_id", "event_id", "ts", "2 hours", "1 day")
            writer = bursts.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
            writer.start(f"{folder}/bursts", format="parquet", outputMode="append").awaitTermination()
    finally:
        spark.conf.set(debounce.PROVIDER, held)
    return spark.read.schema(bursts.schema).parquet(f"{folder}/bursts").withColumn("events_until", scalars.format_utc(F.col("events_until")))


@query("ext5_jsonl_chunk_arrays", "SELECT conv_id AS id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id")
def jsonl_chunk_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker as a column of structs."""
    held = inputs.logs(spark, sf_dir)
    return held.select("id", F.size(chunk.jsonl_array(F.col("body"), scalars.file_name(F.col("path")))).alias("n"))


CHUNK_TABLE = f"""WITH {CHK_PARTS}, plain AS (
  SELECT 'ordinals' AS chunker, doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS line_start, CAST(row_number() OVER w - 1 AS INTEGER) AS line_end, t AS text FROM trimmed WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT * FROM plain UNION ALL SELECT 'markdown', doc_id, line_start, line_end, text FROM markdown"""


@query("ext5_chunk_table_function", CHUNK_TABLE)
def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by number and by line, from chunkers that are plugged into one table function."""
    held = inputs.corpus(spark, sf_dir)
    plain = chunkers.chunk_with(held, chunkers.Chunkers(default=chunkers.ordinals), check=False).withColumn("chunker", F.lit("ordinals"))
    lines = chunkers.chunk_with(held, chunkers.Chunkers.standard()).withColumn("chunker", F.lit("markdown"))
    return plain.unionByName(lines).select("chunker", "doc_id", "line_start", "line_end", "text")


@query("ext5_chunk_table_function_jsonl", ORACLES["chk3_chunk_jsonl"])
def chunk_table_function_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs by the chunker of their extension."""
    return chunkers.chunk_with(inputs.logs(spark, sf_dir), chunkers.Chunkers.standard())


@query(
    "ext5_chunk_sections",
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
marked AS (SELECT *, CAST(sum(CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS part FROM lines)
SELECT doc_id, CAST(min(i) AS INTEGER) AS line_start, CAST(count(*) AS BIGINT) AS n FROM marked GROUP BY doc_id, part""",
)
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third chunker: sections of a text whose every third line is a heading."""
    rows = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("# "), x)).otherwise(F.concat(F.lit("- "), x)))
    docs = inputs.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".sections")).alias("path"), F.array_join(rows, "\n").alias("body"))
    found = chunkers.chunk_with(docs, chunkers.Chunkers.standard().register(chunkers.sections, "sections"))
    return found.select("doc_id", "line_start", (F.col("line_end") - F.col("line_start") + 1).cast("bigint").alias("n"))


@query("rnk1_store_search_fts", ORACLES["rnk1_fts_search_files"])
def store_search_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through a store: the chunks that the postings name, and totals from stored lengths."""
    return _filled(spark, sf_dir).search_fts(TERMS).select("id", "path", F.round("score", 6).alias("score"))


@query(
    "flt6_store_match_language",
    f"WITH {bm25_sql(['apache license', 'idiot', 'version'], '({0} OR {1}) AND NOT {2}')}, {files_sql()} SELECT id, path, round(score, 6) AS score FROM grouped",
)
def store_match_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, OR, NOT and a term that is too short, through a store's postings."""
    return _filled(spark, sf_dir).search_fts('("Apache License" OR idiot ab) NOT version').select("id", "path", F.round("score", 6).alias("score"))


@query(
    "ext7_replicate_two_hosts",
    f"""WITH states AS (SELECT *, doc_id % 11 = 0 AS gone, doc_id % 7 = 0 AS at_b, doc_id % 5 = 0 AS at_a FROM documents)
SELECT {_TREE} AS path, CASE WHEN gone OR at_b THEN 'b' ELSE 'a' END AS host, gone AS deleted,
  CASE WHEN NOT gone THEN sha256(CASE WHEN at_b THEN 'changed at b' WHEN at_a THEN 'changed at a' ELSE text END) END AS hash, true AS same FROM states""",
)
def replicate_two_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of host a, exchanged with b; both change some, b later and with deletions; what a holds then, and whether b holds the same."""
    folder, clock = tree.local(_scratch(spark)), count(1)
    rows = inputs.table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("body"))
    hosts = {}
    for name in "ab":
        os.makedirs(f"{folder}/{name}")
        hosts[name] = SharedFolder(spark, f"{folder}/{name}", f"{folder}/shared", name, now=lambda: next(clock) * 1_000_000)
    _written(rows, hosts["a"].root)
    for name in "ab":
        hosts[name].sync()
    _written(rows.filter("doc_id % 5 = 0").withColumn("body", F.lit("changed at a")), hosts["a"].root)
    _written(rows.filter("doc_id % 7 = 0").withColumn("body", F.lit("changed at b")), hosts["b"].root)
    _removed(rows.filter("doc_id % 11 = 0"), hosts["b"].root)
    for name in "aba":
        hosts[name].sync()
    key = ["path", "time", "host", "deleted"]
    same = hosts["b"].versions().select(*key, F.col("hash").alias("other"))
    both = hosts["a"].versions().join(same, key, "left")
    return both.select("path", "host", "deleted", "hash", F.col("hash").eqNullSafe(F.col("other")).alias("same"))


def _tree_of(spark: SparkSession, sf_dir: str, body: Column | None = None) -> str:
    """The documents as files below a new folder, written by the executors."""
    root = f"{tree.local(_scratch(spark))}/tree"
    docs = inputs.table(spark, sf_dir, "documents")
    _written(docs.select(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("text") if body is None else body).alias("body")), root)
    return root


@query("src4_utf8_files_only", f"SELECT {_TREE} AS path, CAST(length(coalesce(text, '')) AS INTEGER) AS chars FROM documents WHERE doc_id % 9 <> 0")
def utf8_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't UTF-8 (every ninth starts with a wrong byte) are left out."""
    octets = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    root = _tree_of(spark, sf_dir, F.when(F.col("doc_id") % 9 == 0, F.concat(F.unhex(F.lit("FF")), octets)).otherwise(octets))
    bodies = files.read_bodies(files.listing(spark, root))
    return bodies.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), F.length("body").alias("chars"))


@query("src12_list_dir", "SELECT DISTINCT 'en/' || source AS path, true AS is_dir FROM documents WHERE lang = 'en'")
def list_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_dir(spark, _tree_of(spark, sf_dir), "en")


@query("flt4_substring_prefix", f"SELECT doc_id AS id, {PATH} AS path FROM documents WHERE contains(lower(text), 'license') AND starts_with({PATH}, '/ws/en/src') ORDER BY path LIMIT 10")
def substring_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.chunks(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_path").alias("path"), F.col("text").alias("body"))
    return rank.substring_files(docs, "License", path_prefix="/ws/en/src").select("id", "path")


@query("str4_watch_cycles", "SELECT CAST(count(*) AS VARCHAR) || ' indexed, 0 removed' AS said FROM documents")
def watch_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cycles over a tree that doesn't change: the first indexes it, the others have nothing to say."""
    said: list[str] = []
    watch_tree(Workspace(spark, _tree_of(spark, sf_dir), store_path=f"{_scratch(spark)}/store"), interval=0, cycles=3, log=said.append)
    return spark.createDataFrame([(x,) for x in said], "said string")


@query("mnt3_rebuild", "SELECT count(*) AS written, CAST(0 AS BIGINT) AS removed, count(*) AS documents, CAST(0 AS BIGINT) AS problems FROM documents")
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is thrown away and filled from the tree again."""
    workspace = Workspace(spark, _tree_of(spark, sf_dir), store_path=f"{_scratch(spark)}/store")
    workspace.sync()
    written, removed = workspace.rebuild()
    counts = workspace.store.documents().agg(F.count("*").alias("documents")).crossJoin(workspace.store.check().agg(F.count("*").alias("problems")))  # one row each
    return counts.select(F.lit(written).cast("bigint").alias("written"), F.lit(removed).cast("bigint").alias("removed"), "documents", "problems")
