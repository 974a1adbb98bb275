"""Chunkers: documents in, one row per chunk out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scalars import count_newlines, lines, message_text, trim_unicode

BREAK = "\n\n"
#: Between a line and its number; texts may hold it, too.
_MARK = "\x01"


def paragraph_array(body: Column) -> Column:
    """Trimmed non-empty paragraphs as array<string>; may be empty."""
    parts = F.transform(F.split(body, BREAK, -1), trim_unicode)
    return F.filter(parts, lambda p: p != "")


def chunk_paragraphs(docs: DataFrame, id_col: str = "id", body_col: str = "body", path_col: str = "path") -> DataFrame:
    """doc_id, line_start, line_end, text, doc_path with the paragraph's ordinal as both lines."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(path_col).alias("doc_path"), F.posexplode(paragraph_array(F.col(body_col))).alias("i", "text")
    ).select("doc_id", F.col("i").alias("line_start"), F.col("i").alias("line_end"), "text", "doc_path")


def _numbered_paragraphs(body: Column) -> Column:
    """array of (line_start, line_end, text).

    Each line that isn't empty gets its number in front before the text is cut into
    paragraphs, so that no count has to run along; the numbers are taken out again.
    """
    marked = F.transform(F.split(body, "\n", -1), lambda x, i: F.when(x != "", F.concat(i.cast("string"), F.lit(_MARK), x)).otherwise(x))
    parts = F.filter(F.split(F.array_join(marked, "\n"), BREAK, -1), lambda p: (p != "") & (p != "\n"))
    # an odd line end between two paragraphs is at the start of the second
    first = lambda p: F.regexp_extract(p, f"^\n?([0-9]+){_MARK}", 1).cast("int")
    plain = lambda p: F.ltrim(F.regexp_replace(p, f"(?md)^[0-9]+{_MARK}", ""), F.lit("\n"))
    cut = F.transform(parts, lambda p: F.struct(first(p).alias("at"), plain(p).alias("part")))
    trimmed = F.transform(cut, lambda c: F.struct((c["at"] + count_newlines(F.regexp_extract(c["part"], r"(?U)^(\s*)", 1))).cast("int").alias("start"), trim_unicode(c["part"]).alias("text")))
    chunks = F.transform(trimmed, lambda c: F.struct(c["start"].alias("line_start"), (c["start"] + count_newlines(c["text"])).cast("int").alias("line_end"), c["text"].alias("text")))
    return F.filter(chunks, lambda c: c["text"] != "")


def chunk_markdown(docs: DataFrame, id_col: str = "id", body_col: str = "body", path_col: str = "path", title_col: str | None = None) -> DataFrame:
    """The same paragraphs with their true 0-based line range.

    A document without a paragraph gives one chunk that holds its title (the file
    name unless ``title_col`` is given). It all happens inside the row, without a
    shuffle and in time proportional to the text.
    """
    title = F.col(title_col) if title_col else F.element_at(F.split(F.col(path_col), "/"), -1)
    found = _numbered_paragraphs(F.col(body_col))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("doc_path"), found.alias("found"), _whole(title).alias("whole"))
    out = out.select("doc_id", "doc_path", F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("whole"))))
    return out.select("doc_id", "line_start", "line_end", "text", "doc_path")


def chunk_markdown_by_window(docs: DataFrame, id_col: str = "id", body_col: str = "body", path_col: str = "path", title_col: str | None = None) -> DataFrame:
    """Line ranges by a running sum over a window: for documents with very many paragraphs."""
    title = F.col(title_col) if title_col else F.element_at(F.split(F.col(path_col), "/"), -1)
    parts = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("doc_path"), title.alias("title"), F.posexplode(F.split(F.col(body_col), BREAK, -1)).alias("i", "part"))
    own = W.partitionBy("doc_id")
    before = F.coalesce(F.sum(count_newlines(F.col("part")) + 2).over(own.orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = trim_unicode(F.col("part"))
    start = (F.col("before") + count_newlines(F.regexp_extract("part", r"(?U)^(\s*)", 1))).cast("int")
    rows = parts.withColumn("before", before).withColumn("text", text).withColumn("found", F.max(F.col("text") != "").over(own))
    bare = ~F.col("found") & (F.col("i") == 0)  # stands for a document without paragraphs
    rows = rows.filter(bare | (F.col("text") != "")).withColumn("line_start", F.when(F.col("found"), start).otherwise(0)).withColumn("text", F.when(F.col("found"), F.col("text")).otherwise(F.col("title")))
    end = F.when(F.col("found"), F.col("line_start") + count_newlines(F.col("text"))).otherwise(0)
    return rows.select("doc_id", "line_start", end.cast("int").alias("line_end"), "text", "doc_path")


def _jsonl_chunks(body: Column) -> Column:
    """Chunks of the lines with text; each line is parsed once."""
    parsed = F.transform(lines(body), lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.try_parse_json(x).alias("json")))
    text = lambda p: F.when(trim_unicode(p["line"]) != "", message_text(p["line"], p["json"]))
    parts = F.transform(parsed, lambda p: F.struct(p["i"].alias("line_start"), p["i"].alias("line_end"), text(p).alias("text")))
    return F.filter(parts, lambda c: c["text"] != "")


def _whole(title: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), title.alias("text")))


def chunk_jsonl(docs: DataFrame, id_col: str = "id", body_col: str = "body", path_col: str = "path") -> DataFrame:
    """One chunk per non-blank line of a JSONL body, at its line number (blank lines count).

    A document without any gives one chunk with the file name. All of it happens
    inside the row, so there is no shuffle.
    """
    title = F.element_at(F.split(F.col(path_col), "/"), -1)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("doc_path"), _jsonl_chunks(F.col(body_col)).alias("found"), _whole(title).alias("whole"))
    out = out.select("doc_id", "doc_path", F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("whole"))))
    return out.select("doc_id", "line_start", "line_end", "text", "doc_path")


def jsonl_array(body: Column, title: Column) -> Column:
    """The same as array<struct> inside the row, title fallback included."""
    found = _jsonl_chunks(body)
    return F.when(F.size(found) > 0, found).otherwise(_whole(title))
