"""Trigram postings: which chunks contain which three characters.

They turn a full-text search's pass over all text into a look-up of a few trigrams
and an exact check of the chunks that have all trigrams of a phrase. The store keeps
them with the chunks, sorted by trigram, so that row groups' statistics leave out
nearly all of the table; a common trigram's rows are spread over files by document.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schemas

#: Bytes of text that are looked at together (one chunk at least), and rows of a batch that goes out.
GROUP_BYTES, ROWS = 2 << 20, 50_000
#: Code points, and what a key of trigram and chunk stays below.
_POINTS, _KEYS = 0x110000, 1 << 63


def trigrams(chunks: DataFrame) -> DataFrame:
    """trigram, doc_id, line_start: each distinct trigram of a chunk's lower-cased text once.

    Rows come in runs that are in the postings' order, which makes sorting them cheap.
    """
    low = F.lower("text")
    held = chunks.filter(F.length(low) >= 3).select(F.col("doc_id").cast("bigint"), F.col("line_start").cast("int"), low.cast("binary").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch):
                yield from _distinct(group)

    return held.mapInArrow(run, schemas.POSTINGS)


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of GROUP_BYTES of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + GROUP_BYTES, "right")), at + 1)
        yield batch.slice(at, to - at).sort_by([("doc_id", "ascending"), ("line_start", "ascending")])
        at = to


def _distinct(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of the postings by trigram, each once in a chunk."""
    rows = group.num_rows
    texts = [x.decode("utf-8", "replace") for x in group.column(2).to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(_POINTS, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    n = len(alphabet)
    if n**3 * rows >= _KEYS and rows > 1:
        yield from _distinct(group.slice(0, rows // 2))
        yield from _distinct(group.slice(rows // 2))
        return
    # trigrams as numbers in the alphabet's base keep their order, which is that of their UTF-8, too
    number = np.zeros(_POINTS, np.int64)
    number[alphabet] = np.arange(n)
    code = number[points]
    row = np.repeat(np.arange(rows), [len(t) for t in texts])
    keys = (((code[:-2] * n + code[1:-1]) * n + code[2:]) * rows + row[:-2])[row[:-2] == row[2:]]
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    gram, row = np.divmod(keys[first], rows)
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    own = gram[new]
    three = alphabet[np.stack([own // (n * n), own // n % n, own % n], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
    names = pa.array([three[i : i + 3] for i in range(0, len(three), 3)], pa.string())
    name = np.cumsum(new) - 1
    for at in range(0, len(gram), ROWS):
        part = slice(at, at + ROWS)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(name[part])), *[group.column(k).take(pa.array(row[part])) for k in (0, 1)]], names=["trigram", "doc_id", "line_start"])


def differing(want: DataFrame, held: DataFrame) -> DataFrame:
    """doc_id of the documents whose postings are not the same rows in both, by sums of two 64-bit hashes of a chunk's trigrams.

    Postings are summed up where they are read: what is shuffled is a row for each chunk and task.
    """
    keys, hashes = ["doc_id", "line_start"], [F.xxhash64("trigram"), F.xxhash64("trigram", F.lit(1))]
    halves = [x for h in hashes for x in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]  # whose sums don't overflow

    def sums(df: DataFrame, sign: int) -> DataFrame:
        parts: list[Column] = [F.count("*"), *[F.sum(x) for x in halves]]
        return df.groupBy(*keys).agg(*[(sign * p).alias(f"s{i}") for i, p in enumerate(parts)])

    both = sums(want, 1).unionByName(sums(held, -1)).groupBy(*keys).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(halves) + 1)])
    return both.filter(reduce(operator.or_, [F.col(f"s{i}") != 0 for i in range(len(halves) + 1)])).select("doc_id").distinct()


def candidates(postings: DataFrame, phrase: str) -> DataFrame:
    """doc_id, line_start of the chunks that have every trigram of a phrase (it may still be missing)."""
    low = phrase.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    # equalities reach the files' statistics at any number; a long list of values would only as a range
    found = postings.filter(reduce(operator.or_, [F.col("trigram") == g for g in grams]))
    return found.groupBy("doc_id", "line_start").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(grams)).select("doc_id", "line_start")
