"""Similarity self-join of documents on word n-grams: MinHash banding, then exact checks.

1. Each text becomes the set of its n-grams (five lower-cased words; a shorter
   text is one n-gram of all its words). Documents with one set form a class, and
   from here on a class has one representative.
2. A signature of minimum hashes is cut into bands. The numbers of bands and rows
   are chosen so that a pair at the threshold meets in some band with probability
   ``recall`` at least. Only band hashes are shuffled; representatives that share
   one are linked to the least of them, which keeps links in proportion to rows.
3. Connected links make candidate groups. Every pair within a group is decided on
   the full n-gram sets. Groups are dealt out in blocks of about BLOCK members and
   BLOCK_GRAMS n-grams at most, a task sees two blocks at most, and pairs stay inside
   the task: what leaves it is one row per member with its number of links and the
   least member it is linked to.
   In a group of several blocks, members that are close to its centre (the n-grams
   that most members have) need no comparison among each other: Jaccard distance obeys
   the triangle inequality, so two sets within half of the allowed distance of a third
   are similar for sure. These core members are counted; only the others are compared,
   with all.
4. Checked links make the result's classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quarry.llm.common import discard, join_by_size, join_salted, located, materialise, only, slices, text_of, without
from quarry.llm.components import components

N, THRESHOLD, RECALL, MAX_BANDS = 5, 0.8, 0.99999, 25
#: Members of a block of a candidate group, and n-grams of all of them together.
BLOCK, BLOCK_GRAMS = 512, 1_000_000
_SEED = 0x5EED

BASE = "row long, doc_id long, file long, at long, size long, k1 long, k2 long, bands array<long>"


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``most`` bands still give the recall.

    A pair with similarity t meets with probability 1 - (1 - t ** rows) ** bands.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)) if threshold < 1 else 1, 1)
    for rows in range(2, 64):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands > most:
            break
        best = (bands, rows)
    return best


class Shingler:
    """n-gram sets and signatures of texts."""

    def __init__(self, n: int, bands: int, rows: int):
        rng = np.random.default_rng(_SEED)
        self.n, self.bands, self.rows = n, bands, rows
        self.odd = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)
        self.mix = rng.integers(0, 1 << 63, max(n, rows) + 1, np.int64).astype(np.uint64) | np.uint64(1)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(self.n, len(hashes))
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            out = _scramble(out + hashes[i : i + len(out)] * self.mix[i])
        return np.unique(out)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minimum of each hash function over the set."""
        base = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(base), 512):  # stays in the processor's cache
            part = base[at : at + 512, None] * self.odd + self.add
            np.minimum(best, part.min(axis=0), out=best)
        return best

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        sig = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.rows):
            out = _scramble(out + sig[:, i] * self.mix[i])
        return out.astype(np.int64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


@lru_cache(8)
def shingler(n: int, bands: int, rows: int) -> Shingler:
    """The one of this process."""
    return Shingler(n, bands, rows)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    digest = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def check_group(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, least) of each member of a group of sets.

    ``links`` counts the documents of the other members whose similarity is at
    least the threshold; ``least`` is the first member that is connected to it.
    With ``side`` only pairs from different sides count.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((m, m), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(first) - 1
    often = np.bincount(number) > 1  # an n-gram of one member adds to no pair
    keep = often[number]
    number, owner = number[keep], owner[keep]
    if len(number):
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
        width = 8192
        for low in range(0, int(number[-1]) + 1, width):
            a, b = np.searchsorted(number, [low, low + width])
            part = np.zeros((m, min(width, int(number[-1]) + 1 - low)), np.float32)
            part[owner[a:b], number[a:b] - low] = 1
            shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= threshold * union - 1e-6
    linked &= union > 0
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    links = linked @ copies
    least = np.arange(m)
    while True:  # spread the least member along links, with shortcuts
        lower = np.where(linked, least[None, :], m).min(axis=1)
        new = np.minimum(least, lower)
        new = np.minimum(new, new[new])
        if (new == least).all():
            return links, least
        least = new


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, block: int, block_grams: int, from_files: bool):
    """(one row per row of ``docs``: row, doc_id, file, at, class_size, n_links, least; ``docs`` with its places; their names).

    ``least`` is the (doc_id, row) of the class's row that stays.
    """
    bands, rows = choose_bands(threshold, recall)
    docs, *place = located(docs, from_files)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(k) for c, k in zip(place, ("file", "at"), strict=True)], text_of(text_col).alias("text"))
    names = [f.split()[0] for f in BASE.split(", ")]
    arrow = pa.schema([(name, pa.int64()) for name in names[:-1]] + [(names[-1], pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = shingler(n, bands, rows), TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in slices(whole, 1000):
                keys, hashes, size = [], [], []
                for text in batch.column(3).to_pylist():
                    found = own.shingles(text)
                    size.append(len(found))
                    keys.append(set_key(found))
                    hashes.append(own.band_hashes(found) if len(found) else np.zeros(0, np.int64))
                columns = [range(at, at + len(keys)), *batch.columns[:3], size, [k[0] for k in keys], [k[1] for k in keys], hashes]
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, columns, strict=True)), schema=arrow)
                at += len(keys)

    base = materialise(source.mapInArrow(sign, BASE), "signatures")
    total = base.count()

    # one representative for each set; hot sets are combined on the map side
    first = F.min(F.struct("row", "file", "at", "size"))
    classes = base.groupBy("k1", "k2").agg(first.alias("own"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "row")).alias("first"))
    classes = materialise(classes.select("k1", "k2", "own.*", "copies", "first"), "classes")
    own_bands = base.select("row", "bands").join(classes.select("row"), "row", "left_semi")
    hashes = own_bands.select("row", F.explode("bands").alias("hash"))

    # links to the least member of each bucket
    buckets = materialise(hashes.groupBy("hash").agg(F.min("row").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    met = join_by_size(hashes, buckets, ["hash"], "n", total).filter("row <> leader")
    groups = materialise(components(met.select(F.col("row").alias("a"), F.col("leader").alias("b"))), "candidates")
    discard(buckets)
    mine = classes.select(F.col("row").alias("node"), "file", "at", "copies", "size")
    sizes = groups.join(mine.select("node", "size"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    members = materialise(join_by_size(groups, materialise(sizes, "sizes"), ["root"], "n", total).join(mine, "node").withColumnRenamed("node", "row"), "members")

    # the texts of the candidates, found by their place
    texts = only(source.select("file", "at", "text"), ["file", "at"], members)
    found = materialise(texts.join(members.hint("merge"), ["file", "at"]).select("row", "root", "n", "grams", "size", "copies", "text"), "texts")

    # the centre of each group of several blocks: the n-grams of more than half of its members
    large = found.filter((F.col("n") > block) | (F.col("grams") > block_grams))
    gram_schema = pa.schema([("root", pa.int64()), ("n", pa.int64()), ("gram", pa.int64()), ("k", pa.int64())])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(n, bands, rows)
        for whole in batches:
            for batch in slices(whole, 500):
                held: dict[tuple[int, int], list[np.ndarray]] = {}
                for root, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.setdefault((root, size), []).append(own.shingles(text))
                for (root, size), sets in held.items():
                    grams, k = np.unique(np.concatenate(sets), return_counts=True)
                    columns = [np.full(len(k), root), np.full(len(k), size), grams.view(np.int64), k]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=gram_schema)

    grams = large.select("root", "n", "text").mapInArrow(count_grams, "root long, n long, gram long, k long")
    common = grams.groupBy("root", "gram").agg(F.sum("k").alias("k"), F.max("n").alias("n")).filter(F.col("k") * 2 > F.col("n"))
    # at most twice the n-grams of an average member
    centres = materialise(common.groupBy("root").agg(F.collect_list("gram").alias("centre"), F.max("n").alias("n")), "centres")

    pairs = join_salted(large.select("row", "root", "n", "copies", "size", "text"), centres, "root", "n", "row").select("row", "root", "copies", "size", "text", "centre")
    core_schema = pa.schema([("row", pa.int64()), ("root", pa.int64()), ("copies", pa.int64()), ("size", pa.int64())])
    close = 1 - (1 - threshold) / 2

    def near_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, centre = shingler(n, bands, rows), None, None
        for whole in batches:
            for batch in slices(whole, 500):
                near, lists, texts = [], batch.column(5), batch.column(4).to_pylist()
                for i, root in enumerate(batch.column(1).to_pylist()):
                    if root != of:
                        of, centre = root, lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    mine = own.shingles(texts[i])
                    shared = len(np.intersect1d(mine, centre, assume_unique=True))
                    near.append(shared >= close * (len(mine) + len(centre) - shared) + 1e-9)
                yield pa.RecordBatch.from_arrays(batch.columns[:4], schema=core_schema).filter(pa.array(near, pa.bool_()))

    core = materialise(pairs.mapInArrow(near_centre, "row long, root long, copies long, size long"), "core")
    cores = core.groupBy("root").agg(F.sum("copies").alias("core_copies"), F.count("*").alias("core_rows"), F.sum("size").alias("core_grams"), F.min("row").alias("least"))
    cores = materialise(cores, "cores")
    among_core = join_by_size(core, cores, ["root"], "core_rows", total).select("row", (F.col("core_copies") - F.col("copies")).alias("links"), "least")

    # the others' blocks come first, then those of the core; a core block meets the others' blocks only
    groups_of = found.groupBy("root").agg(F.max("n").alias("n"), F.max("grams").alias("grams")).join(cores.select("root", "core_rows", "core_grams"), "root", "left").na.fill(0)

    def blocks(members: Column, grams: Column) -> Column:
        return F.greatest(F.ceil(members / block), F.least(members, F.ceil(grams / block_grams))).cast("int")

    groups_of = groups_of.withColumn("q", blocks(F.col("n") - F.col("core_rows"), F.col("grams") - F.col("core_grams"))).withColumn("p", blocks(F.col("core_rows"), F.col("core_grams")))
    placed = join_by_size(found.select("row", "root", "copies"), materialise(groups_of.select("root", "n", "q", "p"), "groups"), ["root"], "n", total)
    placed = placed.join(core.select("row", F.lit(True).alias("core")), "row", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    spot = F.xxhash64("row")
    own_block = F.when(F.col("core"), F.col("q") + F.pmod(spot, F.greatest("p", F.lit(1)))).otherwise(F.pmod(spot, F.greatest("q", F.lit(1)))).cast("int")
    last = F.when(F.col("core"), F.col("q")).otherwise(F.col("q") + F.col("p")) - 1
    meets = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    placed = placed.select("row", "root", "copies", own_block.alias("block"), F.explode(meets).alias("other"))
    task = placed.join(found.select("row", "text"), "row").select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row", "block", "copies", "text",
    ).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "row")

    checked_schema = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(n, bands, rows)
        key, held = None, []

        def out() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], np.int64)
            side = None if key[1] == key[2] else np.array([h[1] for h in held])
            links, least = check_group([h[3] for h in held], np.array([h[2] for h in held], np.int64), side, threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[least])], schema=checked_schema)

        for whole in batches:
            for batch in slices(whole, 1000):
                for root, i, j, row, part, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (root, i, j) != key:
                        if len(held) > 1:
                            yield out()
                        key, held = (root, i, j), []
                    held.append((row, part, copies, own.shingles(text)))
        if len(held) > 1:
            yield out()

    checked = materialise(task.mapInArrow(check, "row long, links long, least long").unionByName(among_core), "checked")
    discard(found, core, centres)
    links = checked.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("row").alias("a"), F.col("least").alias("b")))

    # from classes of equal sets to classes of similar ones, then to documents
    joined = classes.join(links, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
    joined = joined.withColumn("root", F.coalesce("root", "row")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    joined = materialise(joined.select("k1", "k2", "root", "copies", "n_links", "first"), "joined")
    whole = joined.groupBy("root").agg(F.sum("copies").alias("class_size"), F.count("*").alias("n"), F.min("first").alias("least"))
    named = materialise(join_by_size(joined, whole, ["root"], "n", total).select("k1", "k2", "copies", "n_links", "class_size", "least"), "named")
    return join_by_size(base.select("row", "doc_id", "file", "at", "k1", "k2"), named, ["k1", "k2"], "copies", total), docs, place


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
    block: int = BLOCK, block_grams: int = BLOCK_GRAMS, from_files: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, class_size, kept.

    ``n_links`` is the number of other documents whose n-gram set has a Jaccard
    similarity of ``threshold`` or more, copies included. ``class_id`` is the least
    id of those that links connect, ``class_size`` their number, and ``kept`` is
    true for one row of each class (the one with the least id).

    Null counts as empty; texts without words have an empty set and are similar to
    each other only. A pair is found if a chain of shared band hashes connects it,
    which banding misses with probability 1 - ``recall`` at the threshold and far
    less above it; every pair that is reported has been checked on the full sets.
    Rows that repeat an id are documents of their own; an empty table gives no row;
    other columns aren't read. For ``from_files`` see ``common.located``.
    """
    rows, _, _ = _classes(docs, id_col, text_col, n, threshold, recall, block, block_grams, from_files)
    return rows.select(F.col("doc_id").alias(id_col), F.col("least.doc_id").alias("class_id"), "n_links", "class_size", (F.col("row") == F.col("least.row")).alias("kept"))


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
    block: int = BLOCK, block_grams: int = BLOCK_GRAMS, from_files: bool = False,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are: one document of each class stays.

    Classes are those of :func:`similar_documents`: null, empty and wordless texts
    are one class, rows that repeat an id are told apart, whole texts count, an
    empty table stays empty. Columns may have any names. Rows are found again by
    their place in the files, so only those that may go are shuffled.
    """
    rows, docs, place = _classes(docs, id_col, text_col, n, threshold, recall, block, block_grams, from_files)
    dropped = rows.filter("row <> least.row").select(*[F.col(k).alias(c) for c, k in zip(place, ("file", "at"), strict=True)])
    return without(docs, place, materialise(dropped, "dropped")).drop(*place)
