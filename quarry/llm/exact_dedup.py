"""Exact dedup by deterministic block naming, with DataFrame operations only.

Texts are cut into blocks of BLOCK bytes. Equal blocks get the same integer name
by sorting; then the names of adjacent pairs are named in the same way, level by
level, until each document has one name. A name stands for one byte string and a
byte string has one name, so identity is decided by content and never by a hash.

Hashes only route. A name is (bucket of the key's hash, rank of the key among the
bucket's distinct keys), so that sorting is spread over all tasks and names depend
on the data alone, not on how it is partitioned. Keys that hold more than a
thousandth of the rows (at most a thousand) are named apart and joined by
broadcast; their rows carry no content through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import HOT_SHARE, discard, hot_keys, located, materialise, text_of, without

BLOCK = 4096
#: Rows that a bucket has on average.
BUCKET_ROWS = 256
_RANKS = 1 << 32
#: Hot rows are spread over so many made-up buckets.
_SPREAD = 4096


def name_rows(rows: DataFrame, key: list[str], spread: str, total: int) -> DataFrame:
    """Replace the ``key`` columns by ``name``: equal for equal keys, and only for them.

    ``spread`` is a column whose values are spread evenly (a row number).
    """
    route = F.xxhash64(*key)
    hot = hot_keys(rows, route, total)
    buckets = 1
    while buckets * BUCKET_ROWS < total:
        buckets *= 2
    if hot:
        found = rows.filter(route.isin(hot)).select(*key).distinct()
        # one row for each hot key: at most 1 / HOT_SHARE
        named = materialise(found.select(*key, (-F.dense_rank().over(W.orderBy(*key))).cast("long").alias("hot_name")), "hot")
        same = None
        left, right = rows.alias("l"), F.broadcast(named.alias("r"))
        for k in key:
            equal = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
            same = equal if same is None else same & equal
        rows = left.join(right, same, "left").select("l.*", "r.hot_name")
        rows = rows.select(
            *[F.when(F.col("hot_name").isNull(), F.col(k)).alias(k) if k in key else F.col(k) for k in rows.columns if k != "hot_name"],
            "hot_name",
            F.when(F.col("hot_name").isNull(), F.pmod(route, F.lit(buckets))).otherwise(-1 - F.pmod(F.col(spread), F.lit(_SPREAD))).alias("bucket"),
        )
    else:
        rows = rows.select("*", F.lit(None).cast("long").alias("hot_name"), F.pmod(route, F.lit(buckets)).alias("bucket"))
    rank = F.dense_rank().over(W.partitionBy("bucket").orderBy(*key)).cast("long")
    return rows.withColumn("name", F.coalesce("hot_name", F.col("bucket") * _RANKS + rank)).drop("hot_name", "bucket", *key)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, place: Sequence[str] = ()) -> DataFrame:
    """row, doc_id, sha (of the text), level, name and place; (level, name) is the text's identity.

    Every row of ``docs`` has an own ``row`` number; ``place`` is a struct of the
    columns of that name.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length(text_of(text_col)) / F.lit(float(block)))).cast("int")
    total = docs.select(F.sum(parts.cast("long"))).first()[0] or 0  # of blocks
    texts = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), parts.alias("n"), F.struct(F.lit(0).alias("_"), *place).alias("place"),
    ).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("content"), "n", "place",
    )
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("content"), i * block + 1, F.lit(block)))
    blocks = texts.select("row", "doc_id", "sha", "n", "place", F.posexplode(cut).alias("at", "block"))
    # the digest and the place go with the first block only
    blocks = blocks.withColumns({c: F.when(F.col("at") == 0, F.col(c)) for c in ("sha", "place")})
    current = materialise(name_rows(blocks, ["block"], "row", total), "blocks")
    width = current.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    while True:
        done.append(current.filter("n = 1").select("row", "doc_id", "sha", "place", F.lit(level).alias("level"), "name"))
        if width <= 1:
            break
        pairs = materialise(
            current.filter("n > 1").groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
                F.max("doc_id").alias("doc_id"),
                F.max("sha").alias("sha"),
                F.max("place").alias("place"),
                F.max(F.ceil(F.col("n") / 2).cast("int")).alias("n"),
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
                F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"),
            ),
            "pairs",
        )
        current = materialise(name_rows(pairs, ["a", "b"], "row", pairs.count()), "names")
        discard(pairs)
        level, width = level + 1, (width + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _decide(docs: DataFrame, id_col: str, text_col: str, block: int, place: Sequence[str] = ()) -> DataFrame:
    """row, doc_id, sha, place, keep (doc_id and row of the row that stays) and group_size of each row."""
    rows = identities(docs, id_col, text_col, block, place)
    total = rows.count()
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = materialise(groups, "groups")
    large = F.col("group_size") > max(1000.0, total * HOT_SHARE)
    # fewer than 1 / HOT_SHARE groups are large
    hot = F.broadcast(groups.filter(large).select("level", "name", F.col("keep").alias("hot_keep"), F.col("group_size").alias("hot_size")))
    # rows of large groups take no part in the shuffle by name: they go by their row number
    rows = rows.join(hot, ["level", "name"], "left").withColumn("level", F.when(F.col("hot_size").isNull(), F.col("level")).otherwise(-1))
    rows = rows.withColumn("name", F.when(F.col("hot_size").isNull(), F.col("name")).otherwise(F.col("row")))
    found = rows.join(groups.filter(~large), ["level", "name"], "left")
    return found.select(
        "row", "doc_id", "sha", "place",
        F.coalesce("hot_keep", "keep", F.struct("doc_id", "row")).alias("keep"),
        F.coalesce("hot_size", "group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; null counts as empty, and empty
    texts are equal to each other. Of equal texts the row with the largest id
    stays (a null id only if there is no other; of rows that repeat an id, one).
    An empty table gives an empty result. Other columns are not read.
    """
    return _decide(docs, id_col, text_col, block).select(
        F.col("doc_id").alias(id_col),
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, from_files: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without copies: one of each text stays.

    Which one, and what counts as equal, is as in :func:`exact_dedup`: null and
    empty texts are copies of each other, rows that repeat an id are told apart,
    texts of any length are compared whole, an empty table stays empty. Columns
    may have any names. Rows are found again by their place in the files
    (:func:`quarry.llm.common.located`), so only those that may go are shuffled.
    """
    docs, *place = located(docs, from_files)
    decided = _decide(docs, id_col, text_col, block, place)
    dropped = materialise(decided.filter("keep.row <> row").select(*[F.col("place")[c].alias(c) for c in place]), "dropped")
    return without(docs, place, dropped).drop(*place)
