"""Ranking: substring BM25, vector distance, grouping by file and rank fusion.

Scores are lower-is-better, except fused ones. Every order ends in a unique key
(files by path, hits by line), so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.vectors import l2_distance
from quarry.operators.match import Match, occurrences, parse_match

#: Parameters of BM25 and the floor of a term's weight (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Chunks fetched per file asked for, and files per side of a hybrid search.
OVERFETCH, HYBRID_OVERFETCH = 5, 3
RRF_K = 60


def under_prefix(df: DataFrame, prefix: str | None, column: str = "doc_path") -> DataFrame:
    """Rows whose path starts with a literal text; pushed down to Parquet."""
    return df if not prefix else df.filter(F.col(column).startswith(prefix))


def _totals(length: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.avg(F.greatest(length - 2, F.lit(0)).cast("double")).alias("avg_d")]


def totals(chunks: DataFrame, length: Column) -> DataFrame:
    """One row: the number of chunks and their mean length in trigrams."""
    return chunks.agg(*_totals(length))


def corpus_stats(chunks: DataFrame, match: Match, all_chunks: DataFrame | None = None) -> DataFrame:
    """One row: n, avg_d and the number of chunks that contain each phrase (n_0, n_1, ...).

    With ``all_chunks``, the totals of a corpus, ``chunks`` need only be those with a phrase.
    """
    text = F.lower("text")
    counts = [F.count_if(F.contains(text, F.lit(p))).alias(f"n_{i}") for i, p in enumerate(match.phrases)]
    if all_chunks is None:
        return chunks.agg(*_totals(F.length("text")), *counts)
    return all_chunks.crossJoin(chunks.agg(*counts))  # one row each


def bm25(chunks: DataFrame, query: str | Match, path_prefix: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Chunks that match, with ``score``; statistics come from all chunks, before the prefix.

    Two passes over the text: one aggregate for the statistics (a single row, which
    is broadcast) and one for the matching rows.
    """
    match = parse_match(query) if isinstance(query, str) else query
    if match.root.kind == "nothing":
        return chunks.limit(0).withColumn("score", F.lit(0.0))
    stats = corpus_stats(chunks, match, totals)
    low = F.lower("text")
    has = [F.contains(low, F.lit(p)) for p in match.phrases]
    hits = under_prefix(chunks, path_prefix).filter(match.condition(has))
    scored = hits.crossJoin(F.broadcast(stats))  # one row
    d = F.greatest(F.length("text") - 2, F.lit(0)).cast("double")
    total: Column = F.lit(0.0)
    for i, (phrase, counts) in enumerate(zip(match.phrases, match.counted(has), strict=True)):
        f = occurrences(low, phrase).cast("double")
        f = f if counts is None else F.when(counts, f).otherwise(0.0)
        idf = F.greatest(F.log((F.col("n") - F.col(f"n_{i}") + 0.5) / (F.col(f"n_{i}") + 0.5)), F.lit(LEAST_IDF))
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * d / F.col("avg_d")))
    return scored.withColumn("score", -total).select(*chunks.columns, "score")


def best(hits: DataFrame, n: int) -> DataFrame:
    """The n best chunks."""
    return hits.orderBy("score", "doc_path", "line_start").limit(n)


def group_by_file(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (already the best few) as files: id, path, score of the best hit, chunks best first."""
    chunk = F.struct(F.col("score"), F.col("line_start"), F.col("line_end"), F.col("text"))
    files = hits.groupBy("doc_id", "doc_path").agg(F.min("score").alias("score"), F.array_sort(F.collect_list(chunk)).alias("found"))
    shown = F.transform("found", lambda c: F.struct(c["line_start"].alias("line_start"), c["line_end"].alias("line_end"), c["text"].alias("text"), c["score"].alias("score")))
    return files.select(F.col("doc_id").alias("id"), F.col("doc_path").alias("path"), "score", shown.alias("chunks")).orderBy("score", "path").limit(limit)


def fts_chunks(chunks: DataFrame, query: str, limit: int = 10, path_prefix: str | None = None, overfetch: int = OVERFETCH, totals: DataFrame | None = None) -> DataFrame:
    return best(bm25(chunks, query, path_prefix, totals), overfetch * limit)


def fts_files(chunks: DataFrame, query: str, limit: int = 10, path_prefix: str | None = None, overfetch: int = OVERFETCH, totals: DataFrame | None = None) -> DataFrame:
    """Full-text search: the best ``overfetch * limit`` chunks, grouped to ``limit`` files."""
    return group_by_file(fts_chunks(chunks, query, limit, path_prefix, overfetch, totals), limit)


def substring_files(documents: DataFrame, query: str, limit: int = 10, path_prefix: str | None = None) -> DataFrame:
    """Search without an index: files whose body contains the text in any case, by path.

    The score is 0 and the only hit is an empty placeholder.
    """
    held = F.contains(F.lower("body"), F.lower(F.lit(query)))
    hit = F.array(F.struct(F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("").alias("text"), F.lit(0.0).alias("score")))
    found = under_prefix(documents, path_prefix, "path").filter(held).orderBy("path").limit(limit)
    return found.select("id", "path", F.lit(0.0).alias("score"), hit.alias("chunks"))


def nearest_chunks(vectors: DataFrame, query: Sequence[float], k: int, path_prefix: str | None = None) -> DataFrame:
    """Exact nearest neighbours by Euclidean distance; the prefix is applied first."""
    scored = under_prefix(vectors, path_prefix).select("doc_id", "doc_path", "line_start", "line_end", "text", l2_distance(F.col("embedding"), query).alias("score"))
    return best(scored.filter(F.col("score").isNotNull()), k)


def vector_files(vectors: DataFrame, query: Sequence[float], limit: int = 10, path_prefix: str | None = None, overfetch: int = OVERFETCH) -> DataFrame:
    return group_by_file(nearest_chunks(vectors, query, overfetch * limit, path_prefix), limit)


def no_files(df: DataFrame) -> DataFrame:
    """An empty result."""
    return df.sparkSession.createDataFrame([], schemas.RESULTS)


def merge_ranked(fts: DataFrame, semantic: DataFrame, k: int = RRF_K, weight_fts: float = 1.0, weight_semantic: float = 1.0, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two file lists by path.

    A file scores the sum of weight / (k + rank) over the lists that have it; higher
    is better. Of a chunk that both lists hit, the full-text hit stays. ``source``
    tells the hits' scales apart. The lists are a few files long each.
    """
    order = W.orderBy("score", "path")

    def ranked(df: DataFrame, source: str, name: str) -> DataFrame:
        chunks = F.transform("chunks", lambda c: F.struct(*[c[x].alias(x) for x in ("line_start", "line_end", "text", "score")], F.lit(source).alias("source")))
        return df.select("path", F.col("id").alias(f"{name}_id"), F.row_number().over(order).alias(f"{name}_rank"), chunks.alias(f"{name}_chunks"))

    both = ranked(fts, "fts", "f").join(ranked(semantic, "semantic", "s"), "path", "full")
    none = F.array().cast("array<struct<line_start:int,line_end:int,text:string,score:double,source:string>>")
    f, s = F.coalesce("f_chunks", none), F.coalesce("s_chunks", none)
    fresh = F.filter(s, lambda c: ~F.exists(f, lambda h: (h["line_start"] == c["line_start"]) & (h["line_end"] == c["line_end"])))
    score = F.coalesce(F.lit(float(weight_fts)) / (F.col("f_rank") + float(k)), F.lit(0.0)) + F.coalesce(F.lit(float(weight_semantic)) / (F.col("s_rank") + float(k)), F.lit(0.0))
    merged = both.select(F.coalesce("f_id", "s_id").alias("id"), "path", score.alias("score"), F.concat(f, fresh).alias("chunks"))
    return merged.orderBy(F.desc("score"), "path").limit(limit)


def hybrid_files(
    chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: Sequence[float] | None, limit: int = 10, path_prefix: str | None = None,
    k: int = RRF_K, weight_fts: float = 1.0, weight_semantic: float = 1.0, totals: DataFrame | None = None,
) -> DataFrame:
    """Both searches for three times the files, fused; without a query vector the plain full-text result."""
    fts = fts_files(chunks, query, HYBRID_OVERFETCH * limit, path_prefix, totals=totals)
    if query_vector is None or vectors is None:
        return fts.orderBy("score", "path").limit(limit)
    return merge_ranked(fts, vector_files(vectors, query_vector, HYBRID_OVERFETCH * limit, path_prefix), k, weight_fts, weight_semantic, limit)


def flat_hits(files: DataFrame) -> DataFrame:
    """One row per hit of a file list."""
    return files.select("id", "path", F.col("score").alias("file_score"), F.explode("chunks").alias("c")).select("id", "path", "file_score", "c.*")
