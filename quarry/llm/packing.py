"""Hierarchical multi-length packing.

Documents are routed to context-size tiers (the smallest that holds them; what
exceeds the longest tier is cut into full windows first). Each tier is packed
from the longest document down; the gap of a window is filled with the longest
shorter documents that fit, and at last with a piece cut to measure, whose rest
goes back to the tier that suits it. So windows are exactly full, a power of two
long, and only the last window of an input partition may need padding. Full
windows of one tier are dealt to step groups of equal token count such that the
groups' attention costs (squared piece lengths) are level.

Packing runs in one pass without a shuffle, over blocks of at most BLOCK_TOKENS
ids, so memory is bounded by the block and the longest text.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, text_of
from quarry.llm.wordtok import encoder

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group, over all its sequences.
STEP_TOKENS = 8 * 4096
BLOCK_TOKENS = 2_000_000
#: A sequence id is the partition times this plus a running number.
_PER_PARTITION = 1 << 36

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("sequence_tokens", pa.int64()), ("step_group", pa.int64()), ("sequence_cost", pa.int64())]
)
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens long, step_group long, sequence_cost long"

#: (document number in the block, first id, number of ids)
Piece = tuple[int, int, int]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """(tier, pieces) of windows that hold all ids of documents of these lengths.

    All windows but the last are as long as their tier. Lengths of 0 have no
    piece. The result depends on the order of ``lengths`` only.
    """
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    pool: list[tuple[int, int, int]] = []  # (ids left, document, first id left), ascending
    for doc, n in enumerate(lengths):
        whole = n // top
        windows += [(top, [(doc, i * top, top)]) for i in range(whole)]
        if n % top:
            pool.append((n % top, doc, whole * top))
    pool.sort()
    while pool:
        left, doc, at = pool.pop()
        tier = next(t for t in tiers if t >= left)
        pieces, gap = [(doc, at, left)], tier - left
        while gap and pool:
            i = bisect_right(pool, (gap, len(lengths), 0)) - 1
            if i >= 0:
                left, doc, at = pool.pop(i)
                pieces.append((doc, at, left))
                gap -= left
            else:
                left, doc, at = pool.pop(0)  # the shortest, yet too long
                pieces.append((doc, at, gap))
                insort(pool, (left - gap, doc, at + gap))
                gap = 0
        windows.append((tier, pieces))
    return windows


def balance(costs: list[int], group: int) -> list[list[int]]:
    """Deal items to groups of ``group`` items with level costs; the rest (fewer) comes last."""
    order = sorted(range(len(costs)), key=lambda i: (-costs[i], i))
    n = len(order) // group
    dealt: list[list[int]] = [[] for _ in range(n)]
    for k, i in enumerate(order[: n * group]):
        turn, seat = divmod(k, n)
        dealt[seat if turn % 2 == 0 else n - 1 - seat].append(i)
    return [*dealt, order[n * group :]]


class _Packer:
    """Packs the documents of one partition, block by block."""

    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step = tiers, step_tokens
        self.next_sequence = self.next_group = partition * _PER_PARTITION
        self.docs: list[tuple[int, np.ndarray, int, int]] = []  # (doc_id, ids left, ids before them, all ids)
        self.held = 0
        self.rest: dict[int, list] = {t: [] for t in tiers}  # full windows without a group yet

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        windows = pack([len(ids) for _, ids, _, _ in self.docs], self.tiers)
        again = []
        if windows and not last and sum(n for _, _, n in windows[-1][1]) < windows[-1][0]:
            again = windows.pop()[1]  # its documents go on in the next block
        for tier, pieces in windows:
            self.rest[tier].append(self._window(pieces))
        self.docs = [(self.docs[d][0], self.docs[d][1][at : at + n], self.docs[d][2] + at, self.docs[d][3]) for d, at, n in again]
        self.held = sum(len(ids) for _, ids, _, _ in self.docs)
        rows: list[tuple] = []
        for tier in self.tiers:
            done = self.rest[tier]
            *groups, left = balance([cost for _, _, cost in done], max(1, self.step // tier))
            for group in groups:
                rows += self._group([(tier, done[i]) for i in group])
            self.rest[tier] = [done[i] for i in sorted(left)]
        if last:  # what is left of all tiers, up to the step's tokens each
            group, room = [], self.step
            for tier in reversed(self.tiers):
                for window in self.rest[tier]:
                    if tier > room:
                        rows += self._group(group)
                        group, room = [], self.step
                    group.append((tier, window))
                    room -= tier
            rows += self._group(group)
        return rows

    def _window(self, pieces: list[Piece]) -> tuple[list[tuple], int, int]:
        out, offset = [], 0
        for d, at, n in pieces:
            doc_id, ids, before, total = self.docs[d]
            part = ids[at : at + n]
            out.append((doc_id, before + at, n, crc32(np.ascontiguousarray(part, "<u4")), total, offset, part))
            offset += n
        return out, offset, sum(n * n for _, _, n in pieces)

    def _group(self, windows: list) -> list[tuple]:
        rows = []
        for tier, (pieces, tokens, cost) in windows:
            for doc_id, start, n, crc, total, offset, part in pieces:
                rows.append((doc_id, start, n, crc, total, self.next_sequence, offset, tier, tokens, self.next_group, cost, part))
            self.next_sequence += 1
        self.next_group += bool(windows)
        return rows


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    emit_ids: bool = False,
) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id`` and pack all ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, then tier (the window's size before padding), sequence_tokens,
    step_group and sequence_cost; with ``emit_ids`` also ``ids``. A window whose
    sequence_tokens is below its tier is to be padded to the longest tier; there
    is at most one per partition of the input. Repeated rows are separate
    documents; an empty table has no row; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if emit_ids else PIECES

    def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 5000):
            columns = list(zip(*rows[at : at + 5000], strict=True))
            arrays = [pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=False)]
            if emit_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[-1]], schema.field("ids").type))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, end = _Packer(TaskContext.get().partitionId(), tiers, step_tokens), np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = encoder(tokenizer).batch(some.column(1).to_pylist())
                for doc_id, ids in zip(some.column(0).to_pylist(), texts, strict=True):
                    packer.add(doc_id, np.concatenate([ids, end]))
                if packer.held >= block_tokens:
                    yield from batches_of(packer.flush(False))
        yield from batches_of(packer.flush(True))

    small_batches(docs.sparkSession)
    return source.mapInArrow(run, PIECES_SQL + (", ids array<int>" if emit_ids else ""))
