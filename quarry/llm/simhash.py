"""SimHash fingerprints of texts, and all fingerprints within a Hamming radius of each other.

A text's terms are its pairs of adjacent words and, in texts of fewer than FEW_WORDS
words, its runs of GRAM characters; all in lower case. Each term is hashed to BITS
bits and votes with the square root of its count, for 1 or for 0, on every bit of the
fingerprint. Weights are whole numbers, so sums don't depend on the order or the
machine, and equal texts have equal fingerprints. The angle between two texts' terms
is about the share of the bits that differ times pi; its cosine is their likeness.

Fingerprints are found within a radius by permuted block tables: BLOCKS blocks of
bits, of which two fingerprints that differ in at most ``radius`` bits share at least
BLOCKS - radius. There is a table for each choice of so many blocks, keyed by them; a
pair is counted in the first table that has it. Large buckets are compared in
cells of two chunks each, so that no task gets a whole bucket; no pair leaves a task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations
from math import cos, pi

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quarry.llm.common import HOT_SHARE, among, arrow_map, discard, fresh, join_by_size, located, materialise, ranked

BITS, GRAM, FEW_WORDS = 256, 4, 32
#: Terms whose bits are laid out at a time, and words whose hashes a worker keeps.
_TERMS, _WORDS = 8192, 200_000
BLOCKS, RADIUS = 8, 7
#: Fingerprints of a bucket that are compared with each other at a time.
CHUNK = 1024
#: Rows of the documents' order that stay together at least, and such blocks at most.
ORDER_ROWS, ORDER_BLOCKS = 500, 65_536

_LANES = np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers (the multipliers of splitmix64, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    """Fingerprints of texts; keeps the hashes of frequent words."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def terms(self, text: str) -> np.ndarray:
        """A 64-bit hash of every occurrence of a term."""
        text = text.lower()
        words, known = text.split(), self.words
        hashes = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            h = known.get(word)
            if h is None:
                h = xxh3_64_intdigest(word)
                if len(known) >= _WORDS:
                    known.clear()
                known[word] = h
            hashes[i] = h
        pairs = _mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
        if len(words) >= FEW_WORDS or not text:
            return pairs
        grams = [xxh3_64_intdigest(text[i : i + GRAM], 1) for i in range(max(1, len(text) - GRAM + 1))]
        return np.concatenate([pairs, np.array(grams, np.uint64)])

    def __call__(self, text: str) -> bytes:
        terms, counts = np.unique(self.terms(text), return_counts=True)
        weights = np.rint(16 * np.sqrt(counts)).astype(np.float32)
        votes = np.zeros(BITS, np.int64)
        for at in range(0, len(terms), _TERMS):
            lanes = _mixed(terms[at : at + _TERMS, None] + _LANES)
            bits = np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.float32)
            own = weights[at : at + _TERMS]
            votes += (2 * (own @ bits) - own.sum()).astype(np.int64)
        return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """From 0 (nothing in common, or less) to 1 (equal): the cosine that the differing bits stand for."""
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, cos(pi * differing / BITS))


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by the first as many (or all) of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _starts(rows: DataFrame, id_col: str, file: str, at: str) -> list[tuple]:
    """The first row of each block of the order (ids descending, null last; then places), as (id is null, -id, file, at)."""
    order = [F.desc_nulls_last(id_col), F.col(file), F.col(at)]
    (rank,) = fresh(rows, "rank")
    placed = ranked(rows.select(id_col, file, at), order, rank)
    total = placed.count()
    step = max(ORDER_ROWS, -(-total // ORDER_BLOCKS))
    found = placed.filter(F.col(rank) % step == 0).orderBy(rank).collect()  # ORDER_BLOCKS at most
    discard(placed)
    return [(r[id_col] is None, -(r[id_col] or 0), r[file], r[at]) for r in found]


_PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False) -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next lower id (after the last, the first);
    rows that repeat an id follow each other in the order of their places in the
    files, rows without an id come last. Only the ids are sorted as a whole. Texts go
    to the block of the order that they are in, compressed, and the first of each
    block also to the block before, so that every text is shuffled about once.

    Null text counts as empty; texts without terms have the fingerprint of zeros.
    Long texts are read whole. The only document of a table follows itself; an
    empty table gives an empty result. Other columns aren't read.
    """
    rows, file, at = located(docs, from_files)
    starts = _starts(rows, id_col, file, at)
    last = len(starts) - 1

    def dealt(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("block", "guest", "id", "file", "at", "content", "print")}
        prints, pack = _printer(), zstandard.ZstdCompressor(level=1)
        for doc_id, text, f, a in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            key = (doc_id is None, -(doc_id or 0), f, a)
            block = bisect.bisect_right(starts, key) - 1
            row = (doc_id, f, a, pack.compress((text or "").encode()), prints(text or ""))
            ways = [(block, False)]
            if starts[block] == key:
                ways.append(((block or last + 1) - 1, True))
            for way in ways:
                for k, v in zip(out, (*way, *row), strict=True):
                    out[k].append(v)
        return out

    arrow = pa.schema([("block", pa.int32()), ("guest", pa.bool_()), ("id", pa.int64()), ("file", pa.int64()), ("at", pa.int64()), ("content", pa.binary()), ("print", pa.binary())])
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(file).alias("file"), F.col(at).alias("at"))
    sent = arrow_map(source, "block int, guest boolean, id long, file long, at long, content binary, print binary", dealt, arrow, 500)
    ordered = sent.repartition("block").sortWithinPartitions("block", "guest", F.desc_nulls_last("id"), "file", "at")
    arrow_out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, unpack, held = _printer(), zstandard.ZstdDecompressor(), None
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                out: dict[str, list] = {n: [] for n in arrow_out.names}
                part = batch.slice(start, 200)
                for block, doc_id, content, own in zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in ("block", "id", "content", "print")), strict=True):
                    text = unpack.decompress(content).decode()
                    if held and held[0] == block:
                        _, this_id, this_text, this_print = held
                        changed = edited(this_text, text)
                        other = prints(changed)
                        values = (this_id, len(this_text), sha256(changed.encode()).hexdigest(), this_print.hex(), other.hex(), likeness(this_print, other), likeness(this_print, own))
                        for k, v in zip(out, values, strict=True):
                            out[k].append(v)
                    held = (block, doc_id, text, own)
                yield pa.RecordBatch.from_pydict(out, schema=arrow_out)

    return ordered.select("block", "id", "content", "print").mapInArrow(follow, _PRINTS)


_held: list[Fingerprinter] = []


def _printer() -> Fingerprinter:
    """One for each worker."""
    if not _held:
        _held.append(Fingerprinter())
    return _held[0]


def _pairs(a: np.ndarray, b: np.ndarray, radius: int, table: tuple[int, ...], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs within the radius whose first agreeing blocks are those of the table."""
    left, right = [], []
    for at in range(0, len(a), 128):
        differing = a[at : at + 128, None, :] ^ b[None, :, :]
        i, j = np.nonzero(np.bitwise_count(differing).sum(axis=2, dtype=np.int64) <= radius)
        agree = (differing[i, j].view(np.uint8).reshape(len(i), blocks, BITS // 8 // blocks) == 0).all(axis=2)
        chosen = agree & (agree.cumsum(axis=1) <= len(table))
        own = chosen[:, list(table)].all(axis=1)
        left.append(i[own] + at)
        right.append(j[own])
    return np.concatenate(left), np.concatenate(right)


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, copies, within) of (fingerprint, copies), a hexadecimal text once each, for those that have any.

    ``within`` adds the copies of all other fingerprints that differ in at most
    ``radius`` bits. Only buckets that hold more than one fingerprint are shuffled; a
    bucket of m is compared in (m / CHUNK) squared cells.
    """
    if not 0 <= radius < blocks or BITS % (8 * blocks):
        raise ValueError("the radius must be below the number of blocks, and blocks whole bytes")
    tables, width = list(combinations(range(blocks), blocks - radius)), BITS // blocks // 4
    key = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[F.substring("fingerprint", 1 + width * b, width) for b in table]).alias("key")) for t, table in enumerate(tables)]
    rows = prints.select("fingerprint", "copies", F.explode(F.array(*key)).alias("x")).select("fingerprint", "copies", "x.*")
    crowded = materialise(rows.groupBy("t", "key").agg(F.count("*").alias("m")).filter("m > 1"), "crowded")
    (flag,) = fresh(rows, "flag")
    facts = among(rows, ["t", "key"], crowded, flag).filter(flag).drop(flag)
    total = crowded.agg(F.sum("m")).first()[0] or 0
    joined = join_by_size(facts, crowded, ["t", "key"], "m", total)
    chunks, own = F.ceil(F.col("m") / CHUNK).cast("int"), F.col("own")
    spread = joined.withColumn("own", F.pmod(F.xxhash64("fingerprint"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cells = spread.select("t", "key", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "own", "fingerprint", "copies")
    schema = pa.schema([("fingerprint", pa.string()), ("within", pa.int64())])

    def count(cell: tuple, rows: pa.Table) -> pa.Table:
        t, _, i, j = (k.as_py() for k in cell)
        names, copies = rows["fingerprint"].to_pylist(), rows["copies"].to_numpy()
        bits = np.frombuffer(bytes.fromhex("".join(names)), np.uint64).reshape(len(names), BITS // 64)
        side = rows["own"].to_numpy() == i
        first, second = np.flatnonzero(side), np.flatnonzero(side if i == j else ~side)
        within = np.zeros(len(names), np.int64)
        if len(first) and len(second):
            a, b = _pairs(bits[first], bits[second], radius, tables[t], blocks)
            a, b = first[a], second[b]
            a, b = a[a != b], b[a != b]
            np.add.at(within, a, copies[b])
            if i != j:
                np.add.at(within, b, copies[a])
        found = np.flatnonzero(within)
        return pa.table([pa.array([names[x] for x in found], pa.string()), pa.array(within[found])], schema=schema)

    counted = cells.groupBy("t", "key", "i", "j").applyInArrow(count, "fingerprint string, within long")
    return counted.groupBy("fingerprint").agg(F.sum("within").alias("within"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, from_files: bool = False) -> DataFrame:
    """:func:`fingerprint_edits` with ``n_within``: how many other rows have a fingerprint that differs in at most ``radius`` bits."""
    prints = materialise(fingerprint_edits(docs, from_files=from_files), "prints")
    copies = materialise(prints.groupBy("fingerprint").agg(F.count("*").alias("copies")), "copies")
    near = neighbours(copies, radius)
    some = copies.join(near, "fingerprint", "left").select("fingerprint", "copies", (F.col("copies") - 1 + F.coalesce("within", F.lit(0))).alias("n_within"))
    some = materialise(some.filter("n_within > 0"), "near")
    total = prints.count()
    discard(copies)
    marked = among(prints, ["fingerprint"], some, "maybe")
    least = max(1000.0, total * HOT_SHARE)
    hot, others = (some.filter(f).select("fingerprint", "n_within") for f in (F.col("copies") > least, F.col("copies") <= least))
    maybe = marked.filter("maybe").drop("maybe").join(F.broadcast(hot), "fingerprint", "left")  # fewer than 1 / HOT_SHARE
    rest = maybe.filter("n_within IS NULL").drop("n_within").join(others, "fingerprint", "left")
    none = marked.filter("NOT maybe").drop("maybe").withColumn("n_within", F.lit(0).cast("long"))
    out = maybe.filter("n_within IS NOT NULL").unionByName(rest.withColumn("n_within", F.coalesce("n_within", F.lit(0)))).unionByName(none)
    return out.select(*[c.split()[0] for c in _PRINTS.split(", ")], "n_within")
