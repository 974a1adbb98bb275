"""The queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

WORDS = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file is."""
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORDS))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels, from_files=True))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


#: Texts are compared by themselves here; the operator names them by their blocks.
OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_store import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORDS))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), public_tokenizers.PATTERN)


#: The rules that the query applies (fixed values).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS p FROM pages
), cut AS (
  SELECT page_id, CASE WHEN p > 0 THEN substr(u, p + 3) ELSE '' END AS rest FROM parts
), named AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT n.page_id, r_host || r_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.page_id
           ORDER BY len(string_split(r_host, '.')) DESC, length(r_path) DESC) AS rank
  FROM named n JOIN rules r ON (n.host = r_host OR ends_with(n.host, '.' || r_host)) AND starts_with(n.path, r_path)
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON f.page_id = n.page_id AND f.rank = 1
"""



def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.media import documents_as_media

    return documents_as_media(table(spark, sf_dir, "documents"), from_files=True)


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every page, one row each: page_id, position, kind, text, ref, caption."""
    from pyspark.sql import functions as F

    from quarry.llm.media import interleave

    return interleave(table(spark, sf_dir, "pages")).select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")


def pages_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every page with the stored payload of each text block, found by its digest."""
    from quarry.llm.media import pages_as_media

    return pages_as_media(table(spark, sf_dir, "pages"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals under two public tokenizers."""
    from quarry.llm.common import scratch
    from quarry.llm.token_rollup import bytes_counter, maintain, words_counter

    counters = {
        "word_bpe_49k": words_counter(tokenizer_path(WORDS)),
        "byte_bpe_50k": bytes_counter(tokenizer_path(RANKS), public_tokenizers.PATTERN),
    }
    return maintain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch(spark, "rollup"), counters)


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with a count that SQL knows too: runs of non-space characters."""
    from pyspark.sql import functions as F

    from quarry.llm.common import scratch
    from quarry.llm.token_rollup import maintain

    runs = {"runs": F.size(F.regexp_extract_all("text", F.lit(r"[^ \n\t\r]+"), F.lit(0)))}
    return maintain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch(spark, "rollup"), {}, runs)


TOKEN_ROLLUP_WORDS_SQL = r"""
WITH revised AS (
  SELECT doc_id, source, lang,
         array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT starts_with(x, 'Licensed under')), chr(10)) AS t
  FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
)
SELECT source, lang, 'runs' AS tokenizer, count(*) AS docs,
       CAST(sum(len(regexp_extract_all(t, '[^ \n\t\r]+'))) AS BIGINT) AS tokens
FROM revised GROUP BY source, lang
"""



def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), from_files=True)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases the text of a fifth of the rows."""
    from pyspark.sql import functions as F

    from quarry.llm import merkle

    docs = table(spark, sf_dir, "documents")
    lowered = [F.translate(c, _UPPER, _LOWER) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(docs, F.when(chosen, merkle.leaf(lowered)))


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


#: CRC-32 by its bits (the polynomial is a fixed value), since DuckDB has no such function.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""
_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"


def _climb_sql(name: str, leaves: str) -> str:
    """Nodes of all levels over ``leaves`` (tree, pos, n, h), and the runs that they form."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, pos, n, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16, n
), {name}_runs AS (
  SELECT tree, level, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY ALL
), {name}_top AS (SELECT tree, level AS height, h FROM {name} WHERE n = 1)"""


def _fold_sql(name: str, nodes: str, start: str) -> str:
    """Every row of ``start`` (id, tree, pos, h, sibs) folded up to the top of its tree."""
    others = "hs[1:pos % 16] || hs[pos % 16 + 2:]"
    return f"""
{name} AS (
  SELECT id, tree, 0 AS level, pos, h, sibs FROM {start}
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, pos // 16, sha256(array_to_string(hs[1:pos % 16] || [h] || hs[pos % 16 + 2:], '')), sibs || array_to_string({others}, '')
  FROM {name} f JOIN {nodes}_runs r ON r.tree = f.tree AND r.level = f.level AND r.run = pos // 16
)"""


OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
         {_LEAF_SQL.format('text')} AS leaf,
         CASE WHEN {_CRC_SQL} % 5 = 0 THEN {_LEAF_SQL.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other
  FROM documents
), placed AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs
), {_climb_sql('low', 'placed')}, subroots AS (
  SELECT '' AS tree, low_top.tree AS of, h, row_number() OVER (ORDER BY low_top.tree) - 1 AS pos, count(*) OVER () AS n FROM low_top
), {_climb_sql('high', 'subroots')}, starts AS (
  SELECT id, tree, pos, coalesce(other, leaf) AS h, '' AS sibs FROM placed
), {_fold_sql('up', 'low', 'starts')}, middle AS (
  SELECT id, '' AS tree, s.pos, up.h, sibs FROM up JOIN low_top t ON t.tree = up.tree AND t.height = up.level JOIN subroots s ON s.of = up.tree
), {_fold_sql('over', 'high', 'middle')}
SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(sibs) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM over o JOIN high_top r ON r.height = o.level JOIN placed p ON p.id = o.id JOIN low_top t ON t.tree = p.tree
"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lexical import search_documents

    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


#: Every document that shares a term with an item is scored.
OP12_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, {_terms_sql('text')} AS terms FROM documents
), held AS (SELECT *, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0), corpus AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM held
), items AS (SELECT DISTINCT item_id, unnest({_terms_sql('text')}) AS term FROM benchmark), words AS (
  SELECT id, doc_id, n, unnest(terms) AS term FROM held
), postings AS (
  SELECT id, doc_id, n, term, count(*) AS tf FROM words SEMI JOIN items USING (term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus GROUP BY term
), scored AS (
  SELECT item_id, id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term), corpus GROUP BY item_id, id, doc_id
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"), from_files=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_token_store": op5_token_store,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_media": op8_media,
    "op9_token_rollup": op9_token_rollup,
    "op10_ngram_join": op10_ngram_join,
    "op11_merkle": op11_merkle,
    "op12_lexical": op12_lexical,
    "op13_simhash": op13_simhash,
    "token_rollup_words": token_rollup_words,
    "interleaved_pages": interleaved_pages,
    "pages_resolved": pages_resolved,
}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op7_url_filter": OP7_SQL,
    "op11_merkle": OP11_SQL,
    "op12_lexical": OP12_SQL,
    "token_rollup_words": TOKEN_ROLLUP_WORDS_SQL,
}
