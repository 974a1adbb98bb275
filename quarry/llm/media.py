"""Interleaved document sequences with media kept by digest.

``interleave`` parses HTML into the ordered items of a page: text and media
references, each with its position, a reference also with its caption.
``store_payloads`` keeps payloads losslessly as 8-bit grayscale PNG images (64
samples a row) in a table keyed by digest; ``read_media`` reads the stored bytes
back and computes features; ``resolve`` joins references to them by digest.
Payloads themselves are never shuffled: features are computed where the stored
bytes are read, and the join moves digests and features only.
"""

from __future__ import annotations

import struct
from collections import Counter
from hashlib import sha256
from html.parser import HTMLParser
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, join_by_size, located, materialise, scratch, text_of, without

ROW = 64
#: The eight bytes that start every PNG file (fixed value).
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: How a page refers to a payload of the store.
SCHEME = "digest:"

_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "br", "figure", "figcaption", "header", "footer", "main", "blockquote", "pre"}
#: Elements with end tags that may hold figures; the end of one ends what is open inside.
_HOLDERS = {"article", "aside", "blockquote", "body", "div", "figure", "footer", "header", "li", "main", "nav", "ol", "section", "table", "td", "tr", "ul"}
_SILENT = {"script", "style", "noscript", "template", "title"}
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}


def pad(content: bytes) -> bytes:
    """With zero bytes up to a positive multiple of ROW."""
    return content + bytes(-len(content) % ROW or (0 if content else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grayscale image whose samples are the payload's bytes, ROW to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that :func:`to_png` made; checks every checksum."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width, height = 8, b"", 0, 0
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != crc32(kind + body):
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that the store does not write")
    return lines[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and the shares of 8 sample ranges, per mille."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, value = counts.sum(), np.arange(256)
    mean = (counts * value).sum() / n
    share = counts[counts > 0] / n
    bins = counts.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"mean={mean:.4f};std={np.sqrt((counts * (value - mean) ** 2).sum() / n):.4f};entropy={-(share * np.log2(share)).sum():.4f};bins={','.join(map(str, bins))}"


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.open: list[tuple[str, dict]] = []  # elements that hold blocks, with what a figure has so far
        self.held: Counter[str] = Counter()  # their tags
        self.figures: list[dict] = []  # those among them that are figures
        self.caption: list[str] | None = None  # of the innermost figure, while it is read

    def flush(self) -> None:
        text = " ".join(" ".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if text:
            shown = {"kind": "text", "text": text, "ref": None, "caption": None}
            self.figures[-1] |= {"caption": text, "shown": shown}
            self.items.append(shown)  # until a medium takes it

    def close_element(self) -> str:
        self.end_caption()
        tag, held = self.open.pop()
        self.held[tag] -= 1
        if tag == "figure":
            self.figures.pop()
            if held["caption"] and held["media"]:
                held["shown"]["kind"] = None
                for item in held["media"]:
                    item["caption"] = held["caption"]
        return tag

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS:
            self.flush()
        if tag in ("figure", "figcaption"):
            self.end_caption()
        if tag in _HOLDERS:
            held = {"media": [], "caption": None}
            self.open.append((tag, held))
            self.held[tag] += 1
            if tag == "figure":
                self.figures.append(held)
        elif tag == "figcaption" and self.figures and not self.figures[-1]["caption"]:
            self.caption = []
        elif tag in _MEDIA and (source := dict(attrs).get("src")):
            self.flush()
            item = {"kind": _MEDIA[tag], "text": None, "ref": source, "caption": dict(attrs).get("alt") or None}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.end_caption()
        elif tag in _HOLDERS and self.held[tag]:
            while self.close_element() != tag:
                pass

    def finish(self) -> list[dict]:
        self.flush()
        while self.open:
            self.close_element()
        return [item for item in self.items if item["kind"]]

    def parse_marked_section(self, i, report=1):
        """``<![`` starts a bogus comment, as in the HTML standard: up to the next ``>``, or the page's end."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def handle_data(self, data):
        if self.silent:
            return
        (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page in order: kind, text, ref, caption and position.

    A caption is the ``figcaption`` of the innermost figure around the reference
    (before or after it; the first one, if there are more), or else its ``alt``. A
    figure without an end tag ends with the element around it, or the page. A
    caption without a medium, a second one and one outside of figures are text.
    Null and empty pages have no items.
    """
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    return [{"position": i} | item for i, item in enumerate(parser.finish())]


ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row: id, items (array of position, kind, text, ref, caption).

    Null and empty pages have no items, malformed ones those that the parser finds
    (a marked section is a comment), long ones are parsed whole; repeated rows give
    equal rows, an empty table none, and other columns aren't read.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "items": [parse(h) for h in batch.column(1).to_pylist()]}

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    schema = f"{id_col} long, items array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
    return arrow_map(source, schema, rows, pa.schema([(id_col, pa.int64()), ("items", pa.list_(ITEM))]), 500)


def store_payloads(payloads: DataFrame, path: str) -> None:
    """Write (digest, content) rows, one for each digest, as (digest, n_bytes, media): content padded to ROW, as PNG."""

    def rows(batch: pa.RecordBatch) -> dict:
        content = [c or b"" for c in batch.column(1).to_pylist()]
        return {"digest": batch.column(0), "n_bytes": [len(c) for c in content], "media": [to_png(pad(c)) for c in content]}

    arrow = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    stored = arrow_map(payloads.select("digest", "content"), "digest string, n_bytes long, media binary", rows, arrow, 500)
    stored.write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(path)


MEDIA = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored payload, from the stored bytes: sizes, digests and features."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in arrow.names[2:]}
        for media in batch.column(2).to_pylist():
            payload = from_png(media)
            for name, value in zip(out, (len(payload), sha256(payload).hexdigest(), crc32(payload[-ROW:]), len(media), sha256(media).hexdigest(), describe(payload)), strict=True):
                out[name].append(value)
        return {"digest": batch.column(0), "n_bytes": batch.column(1)} | out

    arrow = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    stored = spark.read.schema("digest string, n_bytes long, media binary").parquet(path)
    return arrow_map(stored, MEDIA, rows, arrow, 500)


def resolve(sequences: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """One row per media reference of ``sequences``: id, position, caption and the payload's columns.

    References are joined by digest; a digest that very many of them name goes by
    broadcast. A reference without a payload is left out here and stays in
    ``sequences``.
    """
    items = sequences.select(id_col, F.explode("items").alias("item")).filter(F.col("item.kind") != "text")
    refs = materialise(items.select(id_col, "item.position", "item.caption", F.substring("item.ref", len(SCHEME) + 1, 64).alias("digest")), "refs")
    named = refs.groupBy("digest").agg(F.count("*").alias("named"))
    dim = materialise(media.join(named.hint("merge"), "digest"), "media")
    return join_by_size(refs, dim, ["digest"], "named", refs.count()).drop("named")


def pages_as_media(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Store every text block of the pages once, and resolve the pages' sequences to what is stored.

    One row per item: id, position, kind, ref, caption, digest, n_bytes, media_bytes,
    feature. A text block is a payload, found by its digest in the store, so blocks
    that many pages share are stored once; its position is the one that it has on
    its page. Media that the pages refer to keep position, ref and caption; a ref
    to a digest of the store is resolved, others have no payload. Null and empty
    pages have no items; repeated rows have theirs each; other columns aren't read.
    """
    spark, path = pages.sparkSession, scratch(pages.sparkSession, "media")
    parsed = interleave(pages, id_col, html_col).select(F.col(id_col), F.posexplode("items").alias("at", "item")).select(id_col, "item.*")
    own = F.when(F.col("kind") == "text", F.sha2("text", 256)).when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))
    items = materialise(parsed.withColumn("digest", own), "items")
    blocks = items.filter("kind = 'text'").groupBy("digest").agg(F.first("text").alias("text"))
    store_payloads(blocks.select("digest", F.col("text").cast("binary").alias("content")), path)
    named = items.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("named"))
    dim = materialise(named.join(read_media(spark, path).select("digest", "n_bytes", "media_bytes", "feature"), "digest", "left"), "payloads")
    total = items.count()
    slim = items.select(id_col, "position", "kind", "ref", "caption", "digest")
    found = join_by_size(slim.filter("digest IS NOT NULL"), dim, ["digest"], "named", total).drop("named")
    return found.unionByName(slim.filter("digest IS NULL"), allowMissingColumns=True).select(id_col, "position", "kind", "ref", "caption", "digest", "n_bytes", "media_bytes", "feature")


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False) -> DataFrame:
    """Store each whole text (null: empty) as a payload, once, and resolve a page that shows it.

    One row per row of ``docs``: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, position, caption. Repeated
    rows and equal texts have equal values; an empty table gives no row; other
    columns aren't read. For ``from_files`` see ``common.located``.

    Texts are read twice, to digest and to store them, and never shuffled: of equal
    digests the row in the first place is stored, found by a bitmap of the others.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "media")
    docs, *place = located(docs, from_files)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(place, ("file", "at"), strict=True)])
    place, digest = ["file", "at"], F.sha2("text", 256).alias("digest")
    slim = materialise(texts.select("id", *place, digest), "digests")
    groups = materialise(slim.groupBy("digest").agg(F.min(F.struct(*place)).alias("own"), F.count("*").alias("n")).filter("n > 1"), "copies")
    once = texts
    if not groups.isEmpty():
        copies = join_by_size(slim, groups, ["digest"], "n", slim.count()).filter(F.struct(*place) != F.col("own"))
        once = without(texts, place, materialise(copies.select(*place), "others"))
    store_payloads(once.select(digest, F.col("text").cast("binary").alias("content")), path)
    pages = slim.select(
        F.col("id").alias(id_col),
        F.concat(F.lit(f'<article><figure><img src="{SCHEME}'), "digest", F.lit('"><figcaption>text of '), F.coalesce(F.col("id").cast("string"), F.lit("no id")), F.lit("</figcaption></figure></article>")).alias("html"),
    )
    found = resolve(interleave(pages, id_col), read_media(spark, path), id_col)
    return found.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
