"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, text_of

#: Texts longer than this are cut before they go to the library.
SPLIT_CHARS = 200_000
#: A place where no match of the pre-splitting pattern can cross: matches never
#: go on from a visible character to a space or line end, and no look-ahead
#: reaches back over it. Only ASCII counts, so Unicode versions don't matter.
_SAFE = re.compile(r"[0-9A-Za-z.,;:!?](?=[ \n])")
#: Patterns for which that is true (fixed values); with others texts stay whole.
SAFE_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of this process for a rank file."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def safe_pieces(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """Pieces of about ``size`` characters whose ids are those of the whole text.

    A text without a safe place stays whole from there on.
    """
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def encode(enc, text: str, size: int = SPLIT_CHARS) -> np.ndarray:
    """Token ids of a whole text, special tokens as ordinary text."""
    pieces = safe_pieces(text, size) if enc._pat_str in SAFE_PATTERNS else [text]
    parts = [np.asarray(enc.encode_ordinary(p), np.uint32) for p in pieces]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(enc, ids: np.ndarray) -> bytes:
    """The raw bytes; ids may end inside a character."""
    return enc.decode_bytes(ids.tolist())


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", emit: str = "digests"
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``emit="digests"``: id, n_tokens, sha256 of the ids (little-endian unsigned
    32-bit) and of the decoded bytes. ``emit="ids"``: id, ids, decoded (binary).
    Null and empty texts have no ids. Repeated rows give repeated rows, and no
    other column is read. There is no shuffle: rows stay where they are read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def digests(batch: pa.RecordBatch) -> dict:
        enc = encoding(path, pattern)
        n, a, b = [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode(enc, text)
            n.append(len(ids))
            a.append(sha256(ids.astype("<u4").tobytes()).hexdigest())
            b.append(sha256(decode(enc, ids)).hexdigest())
        return {id_col: batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    def whole(batch: pa.RecordBatch) -> dict:
        enc = encoding(path, pattern)
        ids = [encode(enc, text) for text in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "ids": [i.astype(np.int32) for i in ids], "decoded": [decode(enc, i) for i in ids]}

    if emit == "ids":
        arrow = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
        return arrow_map(source, f"{id_col} long, ids array<int>, decoded binary", whole, arrow, 500)
    arrow = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return arrow_map(source, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests, arrow)
