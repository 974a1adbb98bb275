"""Chunkers as plug-ins: Python functions behind one table function.

A chunker takes a title (the file's name) and the content and gives chunks (first
line, last line, text). The rules: at least one chunk, in the order of the lines, no
two with the same first line, and no blank line within a text. A chunker that breaks
them fails the query, as its chunks would overwrite each other in a store.

Chunkers are found by the path's extension in a :class:`Chunkers` table and run in a
lateral join: rows go to Python in Arrow batches where they are, without a shuffle.
What ``operators.chunk`` does in the row natively is the faster way for the kinds
that it knows; the chunkers here give the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import CONTENT_KEYS, ROLE_KEYS, extension, file_name

Chunk = tuple[int, int, str]
Chunker = Callable[[str, str], Iterable[Chunk]]

_LINE = re.compile(r"\r?\n")
_HEADING = re.compile(r"#{1,6}(?:\s|$)")
_FENCE = re.compile(r"\s*(```|~~~)")


class ChunkerError(ValueError):
    """A chunker broke the rules."""


def normalise(text: str) -> str:
    """Two line ends become one, once; white space at the ends goes."""
    return text.replace("\n\n", "\n").strip()


def ordinals(title: str, content: str) -> Iterator[Chunk]:
    """Paragraphs with their number as both lines; there may be none."""
    parts = (p.strip() for p in content.split("\n\n"))
    for i, text in enumerate(p for p in parts if p):
        yield i, i, text


def markdown(title: str, content: str) -> Iterator[Chunk]:
    """Paragraphs with the lines that they take; the title if there are none."""
    line, found = 0, False
    for part in content.split("\n\n"):
        text = part.strip()
        if text:
            start = line + part[: len(part) - len(part.lstrip())].count("\n")
            yield start, start + text.count("\n"), text
            found = True
        line += part.count("\n") + 2
    if not found:
        yield 0, 0, title


def message(line: str) -> str:
    """The text of one JSON line: what its speaker says, else its texts, else the line."""
    try:
        held = json.loads(line)
    except ValueError:
        return normalise(line)
    if not isinstance(held, dict):
        return normalise(json.dumps(held, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
    texts = {k: v for k, v in held.items() if isinstance(v, str)}
    content = next((texts[k] for k in CONTENT_KEYS if k in texts), None)
    role = next((texts[k] for k in ROLE_KEYS if k in texts), "")
    if content is not None:
        return normalise(f"{role}: {content}" if role else content)
    if texts:
        return normalise("\n".join(f"{k}: {texts[k]}" for k in sorted(texts)))
    return normalise(json.dumps(held, ensure_ascii=False, separators=(",", ":"), sort_keys=True))


def jsonl(title: str, content: str) -> Iterator[Chunk]:
    """Messages, one a line, with the number of their line; the title if there are none."""
    found = False
    for i, line in enumerate(_LINE.split(content)):
        if line.strip() and (text := message(line)):
            yield i, i, text
            found = True
    if not found:
        yield 0, 0, title


def sections(title: str, content: str) -> Iterator[Chunk]:
    """Parts of a Markdown text that start with a heading (what comes before the first is one, too).

    Hashes inside fenced code are no headings. Blank lines go from the texts, so a
    chunk's lines are where it starts and ends.
    """
    fenced, start, held, found = False, 0, [], False

    def part(end: int) -> Iterator[Chunk]:
        full = [i for i, line in enumerate(held) if line.strip()]
        if full:
            yield start + full[0], start + full[-1], "\n".join(held[i] for i in full).strip()

    rows = content.split("\n")
    for i, line in enumerate(rows):
        if _FENCE.match(line):
            fenced = not fenced
        if not fenced and _HEADING.match(line) and held:
            for chunk in part(i):
                found = True
                yield chunk
            start, held = i, []
        held.append(line)
    for chunk in part(len(rows)):
        found = True
        yield chunk
    if not found:
        yield 0, 0, title


def checked(chunks: Iterable[Chunk], title: str) -> Iterator[Chunk]:
    """The chunks, which must keep the rules."""
    last = -1
    for start, end, text in chunks:
        if start <= last or end < start:
            raise ChunkerError(f"{title}: lines {start} to {end} after {last}")
        if "\n\n" in text:
            raise ChunkerError(f"{title}: a blank line in the chunk at line {start}")
        yield start, end, text
        last = start
    if last < 0:
        raise ChunkerError(f"{title}: no chunk")


@dataclass
class Chunkers:
    """Chunkers by extension. Others may be added; the last one for an extension counts."""

    by_extension: dict[str, Chunker] = field(default_factory=dict)
    default: Chunker = markdown

    @classmethod
    def standard(cls) -> Chunkers:
        return cls({"jsonl": jsonl})

    def register(self, chunker: Chunker, *extensions: str) -> Chunkers:
        for x in extensions:
            self.by_extension[x.lower().lstrip(".")] = chunker
        return self

    def extensions(self) -> list[str]:
        return sorted(self.by_extension)

    def of(self, kind: str | None) -> Chunker:
        return self.by_extension.get(kind or "", self.default)

    def handles(self, path: Column) -> Column:
        """Whether a path's extension has a chunker of its own here."""
        return extension(path).isin(*self.extensions()) if self.by_extension else F.lit(False)


def table_function(chunkers: Chunkers, check: bool = True):
    """A table function (kind, title, content) -> (line_start, line_end, text) for lateral joins and SQL."""

    class Chunks:
        def eval(self, kind: str, title: str, content: str):
            found = chunkers.of(kind)(title or "", content or "")
            yield from checked(found, title) if check else found

    return F.udtf(Chunks, returnType="line_start int, line_end int, text string", useArrow=True)


def chunk_with(docs: DataFrame, chunkers: Chunkers, check: bool = True, id_col: str = "id", body_col: str = "body", path_col: str = "path") -> DataFrame:
    """doc_id, line_start, line_end, text, doc_path of all documents, each by the chunker of its extension.

    A null body counts as empty. ``check=False`` lets chunkers give no chunk for a
    document, and takes their lines as they are.
    """
    path = F.col(path_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("doc_path"), F.col(body_col).alias("_body"))
    chunks = table_function(chunkers, check)(extension(F.col("doc_path")).outer(), file_name(F.col("doc_path")).outer(), F.col("_body").outer())
    return rows.lateralJoin(chunks).select("doc_id", "line_start", "line_end", "text", "doc_path")
