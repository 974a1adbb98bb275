"""Fast, exact encoding with a ``tokenizers`` file that drops white space.

The file's rules never let a token, a composed character or a case mapping reach
across white space, so the ids of a text are those of its words, one after
another. Texts of ASCII and Latin letters, for which Unicode normalisation does
nothing, are cut further into the pieces that the file's pre-tokenizer makes of
them; other texts only at spaces and line ends. Each distinct piece goes through
the library once and is then taken from a cache of bounded size.

This holds for files whose rules are those in ``_RULES``; that is read from the file.
With any other file every text goes to the library as it is. ``tests/llm`` compares
both with the library on random texts.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Pieces kept per worker process (about 150 bytes each).
CACHE_PIECES = 200_000
#: Characters handled at a time, so that a very long text stays cheap.
SLICE_CHARS = 1_000_000

#: Texts that normalisation only lower-cases, character by character.
_SIMPLE = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
#: The pre-tokenizer's pattern (fixed values), for lower-cased simple texts.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-zß-öø-ſ0-9]+")

#: What the byte-level step makes of each byte: visible ones stay, the others follow from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _VISIBLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

#: Rules of the files for which words may be encoded one by one (fixed values).
_RULES = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}

#: Before a word that the library has to see whole; no piece starts with it.
_WHOLE = "\n"

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class WordEncoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        rules = json.loads(self._lib.to_str())
        added = [t for t in rules["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])]
        self.by_words = not added and all(rules[k] == v for k, v in _RULES.items())
        self._most = cache_pieces
        self._added = [t.content for t in self._lib.get_added_tokens_decoder().values()]
        self._numbers = _Numbers()
        self._pool = np.zeros(1 << 16, np.uint32)
        self._ends = np.zeros(1 << 14, np.int64)  # item i + 1: the end of piece i in the pool
        self._learned = 0
        self._gone = 0

    def _look_up(self, pieces: list[str]) -> list[list[int]]:
        """Ids from the library: by its model alone where the steps before it change nothing."""
        whole = iter(self._lib.encode_batch_fast([p[1:] for p in pieces if p[:1] == _WHOLE], add_special_tokens=False))
        model = self._lib.model.tokenize
        out = []
        for p in pieces:
            if p[:1] == _WHOLE:
                out.append(next(whole).ids)
            else:
                out.append([t.id for t in model(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))])
        return out

    def _learn(self) -> None:
        fresh = self._numbers.fresh
        for at in range(0, len(fresh), 10_000):
            ids = self._look_up(fresh[at : at + 10_000])
            ends = self._ends[self._learned] + np.cumsum([len(i) for i in ids])
            while ends[-1] > len(self._pool):
                self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
            while self._learned + len(ids) >= len(self._ends):
                self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
            self._pool[self._ends[self._learned] : ends[-1]] = [x for i in ids for x in i]
            self._ends[self._learned + 1 : self._learned + 1 + len(ids)] = ends
            self._learned += len(ids)
        fresh.clear()

    def _forget(self) -> None:
        """Make room in a cache that is full.

        The first pieces, which are the frequent ones, stay and the newest go; when
        ten times the cache has gone that way the texts may have changed, and all go.
        """
        self._gone += len(self._numbers) - self._most
        if self._gone > 10 * self._most:
            self._numbers.clear()
            self._gone = 0
        while len(self._numbers) > self._most:
            self._numbers.popitem()
        self._learned = len(self._numbers)

    def _encode(self, pieces: list[str], counts: list[int]) -> list[np.ndarray]:
        """The ids of texts that have ``counts`` of the pieces each."""
        at = np.fromiter(map(self._numbers.__getitem__, pieces), np.int64, len(pieces))
        if self._numbers.fresh:
            self._learn()
        starts = self._ends[at]
        n = self._ends[at + 1] - starts
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = self._pool[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        if len(self._numbers) > self._most:
            self._forget()
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _cut(self, text: str) -> list[str]:
        # the library looks for its added tokens before anything else
        if _SIMPLE.fullmatch(text) and not any(t in text for t in self._added):
            return _PIECE.findall(text.lower())
        return [_WHOLE + word for word in text.replace("\n", " ").split(" ")]

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, without special tokens."""
        if not self.by_words:
            return self._plain([text])[0]
        parts = []
        for part in _slices(text.replace("\n", " ")):
            pieces = self._cut(part)
            parts += self._encode(pieces, [len(pieces)])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text; many short texts share one lookup."""
        if not self.by_words:
            return self._plain(texts)
        collecting = gc.isenabled()
        gc.disable()  # millions of short-lived objects, none in a cycle
        try:
            return self._batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _plain(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._lib.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        pieces: list[str] = []
        counts: list[int] = []
        chars = 0
        for text in texts:
            if chars + len(text) > SLICE_CHARS and counts:
                out += self._encode(pieces, counts)
                pieces, counts, chars = [], [], 0
            if len(text) > SLICE_CHARS:
                out.append(self.ids(text))
                continue
            own = self._cut(text)
            pieces += own
            counts.append(len(own))
            chars += len(text)
        if counts:
            out += self._encode(pieces, counts)
        return out


def _slices(text: str) -> Iterator[str]:
    """Slices of about SLICE_CHARS, cut at spaces (the space itself goes)."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = text.find(" ", at + SLICE_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]
