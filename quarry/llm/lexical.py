"""Ranked lexical search over a clustered index, with exact results.

Similar documents are brought together first: recursive graph bisection cuts a
bounded sample of documents in halves, again and again, so that each half uses few
terms of the other (documents swap sides while that saves logarithmic gaps in
postings). The cuts, as weights of terms, then route every document of the table to
one of the 2 ** DEPTH ends, and documents are dealt out to shards in the order of
these ends. A shard is a row of the index: its documents and lengths, its terms with
their document counts and highest impacts, and the postings.

A query adds the highest impacts of its terms in a shard to a bound on what any
document there can score. Shards are visited by descending bound, the first ones for
all queries at once, and those that are left only if their bound reaches the score
of the last of the best documents so far: a bound equal to it is visited too, since
ties go to the lower doc_id. So nothing that belongs into the result is passed over.

Scores are whole numbers: a term's weight is floor(1000 ln((2N+2) / (2df+1))), its
impact in a document 10^9 tf div (1000 tf + 20 m) with m = 50 + 50 n N div L, where
N counts the documents that have terms, n the document's terms and L all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, discard, materialise, scratch

#: The sample that the cuts are fitted on: documents (on average), and their most frequent terms.
SAMPLE_DOCUMENTS, SAMPLE_TERMS = 4096, 16_384
#: Halvings of the sample, and rounds of swaps for each.
DEPTH, ROUNDS = 6, 20
#: Fewer documents than this aren't halved any more.
LEAST = 16
#: Postings in a shard, on average.
SHARD_POSTINGS = 200_000
#: Queries are taken in blocks of so many items, and of so many terms, on average.
BLOCK_ITEMS, BLOCK_TERMS = 256, 200_000
#: Shards that every query visits first, and then if their bounds allow; all others follow.
FIRST = (2, 16)
#: So many visits are sent to all executors; more are joined.
FEW_VISITS = 4_000_000

#: ASCII letters, lower-cased, digits and all bytes of other characters; a blank for the rest.
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of letters and digits, and of whatever isn't ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(_TERMS).split()


def _gaps(n: int, df: np.ndarray) -> np.ndarray:
    """Bits of the gaps of postings, about: df log2(n / (df + 1))."""
    return df * np.log2(max(n, 1) / (df + 1))


def bisect(documents: list[np.ndarray], terms: int, depth: int = DEPTH, seed: int = 0) -> np.ndarray:
    """Weights (terms, 2 ** depth - 1): those of cut ``c`` send a document right if their sum over its terms is positive.

    Cut 0 halves all documents, cuts 2c + 1 and 2c + 2 the left and the right side
    of cut c. Each halving starts at random and swaps the documents that gain most.
    """
    weights = np.zeros((terms, (1 << depth) - 1), np.float32)
    rng = np.random.default_rng(seed)
    waiting = [(0, np.arange(len(documents)))]
    while waiting:
        cut, held = waiting.pop()
        if cut >= weights.shape[1] or len(held) < LEAST:
            continue
        doc = np.repeat(np.arange(len(held)), [len(documents[i]) for i in held])
        term = np.concatenate([documents[i] for i in held])
        right = rng.permutation(len(held)) >= len(held) // 2
        n_left, n_right = int((~right).sum()), int(right.sum())
        for _ in range(ROUNDS):
            at = right[doc]
            df_left, df_right = (np.bincount(term[side], minlength=terms) for side in (~at, at))
            now = _gaps(n_left, df_left) + _gaps(n_right, df_right)
            go_right = now - _gaps(n_left, np.maximum(df_left - 1, 0)) - _gaps(n_right, df_right + 1)
            go_left = now - _gaps(n_left, df_left + 1) - _gaps(n_right, np.maximum(df_right - 1, 0))
            gain = np.bincount(doc, np.where(at, go_left[term], go_right[term]), len(held))
            left_first, right_first = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (~right, right))
            pairs = min(n_left, n_right)
            swap = gain[left_first[:pairs]] + gain[right_first[:pairs]] > 1e-9
            if not swap.any():
                break
            right[left_first[:pairs][swap]], right[right_first[:pairs][swap]] = True, False
        at = right[doc]
        df_left, df_right = (np.bincount(term[side], minlength=terms) for side in (~at, at))
        weights[:, cut] = (_gaps(n_left, df_left + 1) - _gaps(n_left, df_left)) - (_gaps(n_right, df_right + 1) - _gaps(n_right, df_right))
        weights[(df_left + df_right) == 0, cut] = 0
        waiting += [(2 * cut + 1, held[~right]), (2 * cut + 2, held[right])]
    return weights


def route(weights: np.ndarray, ids: list[int]) -> int:
    """The end (0 to 2 ** depth - 1) that a document with these terms comes to."""
    sums, cut = weights[ids].sum(axis=0), 0
    while cut < len(sums):
        cut = 2 * cut + (2 if sums[cut] > 0 else 1)
    return cut - len(sums)


def fit(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], np.ndarray]:
    """The sample's terms with their rows in the weights, and the weights, fitted in one task on the sample.

    The sample is bounded (SAMPLE_DOCUMENTS on average, of equal texts one), so are
    the terms, and what comes to the driver is 4 bytes for each term and cut.
    """
    total = docs.count()
    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    sample = materialise(texts.sample(min(1.0, SAMPLE_DOCUMENTS / max(total, 1)), seed=1), "sample")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [set(terms_of(t)) for batch in batches for t in batch.column(0).to_pylist()]
        df = Counter(t for terms in found for t in terms)
        kept = sorted((t for t in df if df[t] > 1), key=lambda t: (-df[t], t))[:SAMPLE_TERMS]
        index = {t: i for i, t in enumerate(kept)}
        documents = [np.array(sorted(index[t] for t in terms if t in index), np.int64) for terms in found]
        weights = bisect([d for d in documents if len(d)], len(kept))
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([w.tobytes() for w in weights], pa.binary())], ["term", "weights"])

    rows = sample.distinct().repartition(1).sortWithinPartitions("text").mapInArrow(cuts, "term binary, weights binary").collect()
    discard(sample)
    weights = np.frombuffer(b"".join(r["weights"] for r in rows), np.float32).reshape(len(rows), (1 << DEPTH) - 1)
    return {bytes(r["term"]): i for i, r in enumerate(rows)}, weights


def _routed(docs: DataFrame, model: tuple[dict[bytes, int], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """Documents that have terms: id, n, their distinct terms (blanks between them) with counts, and the end they come to."""
    index, weights = model

    def rows(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {k: [] for k in ("id", "n", "terms", "tfs", "cluster")}
        for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
            words = terms_of(text)
            if not words:
                continue
            counts = Counter(words)
            for k, v in zip(out, (doc_id, len(words), b" ".join(counts), list(counts.values()), route(weights, [i for t in counts if (i := index.get(t)) is not None])), strict=True):
                out[k].append(v)
        return out

    arrow = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.string()), ("tfs", pa.list_(pa.int32())), ("cluster", pa.int32())])
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(source, "id long, n long, terms string, tfs array<int>, cluster int", rows, arrow, 500)


_INDEX = (
    "shard long, n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<string>, dfs array<int>, "
    "tops array<long>, docs array<int>, tfs array<int>"
)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's impact in documents of ``n`` terms that hold it ``tf`` times (whole numbers)."""
    tf, m = tf.astype(np.int64), 50 + 50 * n.astype(np.int64) * documents // max(total, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all rows that have terms to ``path``, one row a shard.

    Null and empty texts, and texts without terms, have none and can't be found;
    long texts are read whole; rows that repeat an id are documents of their own; an
    empty table gives an empty index. Other columns aren't read.
    """
    routed = materialise(_routed(docs, fit(docs, text_col), id_col, text_col).withColumn("u", F.rand(7)), "routed")
    cost = F.size("tfs").cast("long")
    held = {r["cluster"]: (r["docs"], r["terms"], r["cost"]) for r in routed.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(cost).alias("cost")).collect()}
    documents, total = (sum(x[i] for x in held.values()) for i in (0, 1))
    starts, sizes, at = [], [], 0
    for cluster in range(1 << DEPTH):  # ends in their order: neighbours share cuts
        size = held.get(cluster, (0, 0, 0))[2]
        starts.append(at)
        sizes.append(size)
        at += size
    own = F.col("cluster") + 1
    place = F.element_at(F.lit(starts), own) + F.col("u") * F.element_at(F.lit(sizes), own)
    shards = routed.select(F.floor(place / SHARD_POSTINGS).alias("shard"), "id", "n", "terms", "tfs")

    def shard(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        flat = pc.list_flatten(pc.split_pattern(rows["terms"], " ")).combine_chunks()
        counts = pc.list_flatten(rows["tfs"]).to_numpy().astype(np.int64)
        lengths = rows["n"].to_numpy()
        doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["tfs"]).to_numpy())
        named = flat.dictionary_encode()
        if isinstance(named, pa.ChunkedArray):
            named = named.combine_chunks()
        code = named.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        dfs = np.bincount(code, minlength=len(named.dictionary))
        tops = np.maximum.reduceat(impacts(counts, lengths[doc], documents, total)[order], np.cumsum(dfs) - dfs)
        one = [key[0].as_py(), rows.num_rows, int(lengths.sum()), rows["id"].to_pylist(), lengths, named.dictionary.to_pylist(), dfs, tops, doc[order], counts[order]]
        kinds = [pa.int64()] * 3 + [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())]
        return pa.table([pa.array([v], t) for v, t in zip(one, kinds, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])

    shards.groupBy("shard").applyInArrow(shard, _INDEX).write.option("compression", "zstd").parquet(path)
    discard(routed)


class _Queries:
    """A block of items: their terms as numbers in the block's vocabulary, and the terms' weights."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary = sorted({t for r in rows for t in r["terms"]})
        at = {t: i for i, t in enumerate(self.vocabulary)}
        self.terms = [np.array([at[t] for t in r["terms"]], np.int64) for r in rows]
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.least = np.ones(len(rows), np.int64)
        self.documents = self.total = 0

    def weigh(self, dfs: dict[int, int], documents: int, total: int) -> None:
        self.documents, self.total = documents, total
        for i, df in dfs.items():
            self.weights[i] = floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def _seen(index: DataFrame, block: _Queries) -> DataFrame:
    """Of each shard, the block's terms with their document counts and highest impacts."""
    vocabulary = block.vocabulary

    def rows(batch: pa.RecordBatch) -> dict:
        known = pa.array(vocabulary, pa.string())
        out: dict[str, list] = {k: [] for k in ("shard", "terms", "dfs", "tops")}
        for i in range(batch.num_rows):
            found = pc.index_in(batch.column(1)[i].values, value_set=known)
            mask = found.is_valid()
            if pc.any(mask).as_py():
                for k, v in zip(out, (batch.column(0)[i].as_py(), found.filter(mask), batch.column(2)[i].values.filter(mask), batch.column(3)[i].values.filter(mask)), strict=True):
                    out[k].append(v)
        return out

    arrow = pa.schema([("shard", pa.int64()), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int32())), ("tops", pa.list_(pa.int64()))])
    return arrow_map(index.select("shard", "terms", "dfs", "tops"), "shard long, terms array<int>, dfs array<int>, tops array<long>", rows, arrow, 16)


def _bounds(seen: DataFrame, block: _Queries) -> DataFrame:
    """What a document of the shard can score at most for an item: (item, shard, bound), where that isn't zero."""
    flat = np.concatenate(block.terms)
    starts = np.cumsum([0, *[len(t) for t in block.terms[:-1]]])

    def rows(batch: pa.RecordBatch) -> dict:
        items, shards, bounds = [], [], []
        for i in range(batch.num_rows):
            most = np.zeros(len(block.weights), np.int64)
            ids = batch.column(1)[i].values.to_numpy()
            most[ids] = block.weights[ids] * batch.column(2)[i].values.to_numpy()
            sums = np.add.reduceat(most[flat], starts)
            own = np.flatnonzero(sums)
            items.append(own)
            shards.append(np.full(len(own), batch.column(0)[i].as_py()))
            bounds.append(sums[own])
        return {"item": np.concatenate(items).astype(np.int32), "shard": np.concatenate(shards), "bound": np.concatenate(bounds)}

    arrow = pa.schema([("item", pa.int32()), ("shard", pa.int64()), ("bound", pa.int64())])
    return arrow_map(seen.select("shard", "terms", "tops"), "item int, shard long, bound long", rows, arrow, 200)


def _visited(index: DataFrame, visits: DataFrame, count: int, block: _Queries, k: int) -> DataFrame:
    """The best ``k`` documents of each visited shard for each item that visits it: (item, doc_id, score)."""
    lists = visits.groupBy("shard").agg(F.collect_list("item").alias("items"))  # as many as a block has items
    lists = F.broadcast(lists) if count <= FEW_VISITS else lists.hint("merge")
    rows = index.select("shard", "ids", "lengths", "terms", "dfs", "docs", "tfs").join(lists, "shard")

    def score(batch: pa.RecordBatch) -> dict:
        known = pa.array(block.vocabulary, pa.string())
        out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
        for i in range(batch.num_rows):
            ids, lengths, terms, dfs, docs, tfs, items = (batch.column(c)[i].values for c in range(1, 8))
            dfs, docs, lengths = dfs.to_numpy(), docs.to_numpy(), lengths.to_numpy()
            ends = np.cumsum(dfs)
            found = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()
            place = np.full(len(block.weights), -1)
            place[found[found >= 0]] = np.flatnonzero(found >= 0)
            order = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy()
            weight = np.repeat(np.where(found >= 0, block.weights[found], 0), dfs)
            posted = (weight * impacts(tfs.to_numpy(), lengths[docs], block.documents, block.total)).astype(np.float64)  # sums stay far below 2 ** 53
            for item in items.to_pylist():
                at = place[block.terms[item]]
                at = at[at >= 0]
                own = np.concatenate([np.arange(ends[t] - dfs[t], ends[t]) for t in at]) if len(at) else np.zeros(0, np.int64)
                scores = np.bincount(docs[own], posted[own], len(lengths)).astype(np.int64)
                best = np.flatnonzero(scores >= block.least[item])
                if len(best) > k:
                    best = best[scores[best] >= np.partition(scores[best], -k)[-k]]
                best = best[np.lexsort((order[best], -scores[best]))][:k]
                out["item"] += [item] * len(best)
                out["doc_id"] += ids.take(pa.array(best)).to_pylist()
                out["score"] += scores[best].tolist()
        return out

    arrow = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
    return arrow_map(rows, "item int, doc_id long, score long", score, arrow, 4)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(index: DataFrame, block: _Queries, documents: int, total: int, k: int) -> DataFrame:
    seen = materialise(_seen(index, block), "seen")
    dfs = seen.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    block.weigh({r["terms"]: r["df"] for r in dfs.collect()}, documents, total)  # at most the vocabulary
    bounds = materialise(_bounds(seen, block), "bounds")
    discard(seen)
    best, visits, left = None, [], bounds
    for most in (*FIRST, None):
        if most:
            order = W.partitionBy("item").orderBy(F.desc("bound"), "shard")
            chosen = left.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most).drop("at")
        else:
            chosen = left
        chosen = materialise(chosen, "visits")
        count = chosen.count()
        found = _visited(index, chosen, count, block, k) if count else None
        visits.append(chosen)
        if found is not None:
            found = found if best is None else found.unionByName(best.select("item", "doc_id", "score"))
            better = materialise(_best(found, k), "best")
            if best is not None:
                discard(best)
            best = better
        if most and best is not None:
            for r in best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():  # one row an item
                block.least[r["item"]] = r["least"]
            least = F.element_at(F.lit(block.least.tolist()), F.col("item") + 1)
            done = visits[0] if len(visits) == 1 else visits[0].unionByName(visits[1])
            left = bounds.filter(F.col("bound") >= least).join(done.select("item", "shard"), ["item", "shard"], "left_anti")
    discard(bounds, *visits)
    return best


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item, by score and then by doc_id: item_id, rank, doc_id, score.

    Items are the terms of their texts, once each; rows that repeat an id are one
    item with the terms of all. Items without terms (null, empty), and documents that
    share no term with an item or score nothing, have no rows. Null ids (of items or
    documents) are ids like others, null documents first among equals.
    """
    spark = index.sparkSession

    def rows(batch: pa.RecordBatch) -> dict:
        return {"item_id": batch.column(0), "terms": [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]}

    arrow = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.string()))])
    source = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    terms = arrow_map(source, "item_id long, terms array<string>", rows, arrow, 500).groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    queries = materialise(terms.filter(F.size("terms") > 0), "queries")
    count, words = queries.agg(F.count("*"), F.sum(F.size("terms"))).first()
    documents, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    blocks = max(-(-count // BLOCK_ITEMS), -(-(words or 0) // BLOCK_TERMS))
    out = spark.createDataFrame([], f"{id_col} long, rank int, doc_id long, score long")
    if not documents:
        return out
    for b in range(blocks):
        held = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block of queries
        if not held:
            continue
        block = _Queries(held)
        best = _search_block(index, block, documents, total, k)
        if best is not None:
            names = F.lit([-1 if i is None else i for i in block.ids])
            own = F.when(F.element_at(F.lit([i is not None for i in block.ids]), F.col("item") + 1), F.element_at(names, F.col("item") + 1))
            out = out.unionByName(best.select(own.alias(id_col), "rank", "doc_id", "score"))
    discard(queries)
    return out


def search_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index ``docs`` in the scratch folder and search it for ``items``."""
    path = scratch(docs.sparkSession, "index")
    build_index(docs, path)
    return search(docs.sparkSession.read.schema(_INDEX).parquet(path), items, k)
