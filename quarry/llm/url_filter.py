"""URL filters: a trie over reversed host labels and path segments.

Rules are (verdict, host, path). A rule fits its host and every subdomain of it
if the url's path starts with the rule's path. Of all that fit, the one with the
most host labels wins, then the one with the longest path; allow and block rules
compete on equal terms (of two rules with the same host and path the block wins).

The trie is broadcast while it has at most ``max_trie_rules`` rules. A larger
rule table is joined instead: the keys a url can match are generated from it, so
the work stays in proportion to the urls, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, discard, join_by_size, materialise

#: Rules up to which the trie is broadcast (some 100 bytes each).
MAX_TRIE_RULES = 200_000

Rule = tuple[str, str, str]  # verdict, host, path

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"[\s\S]*?://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/ ? #``; then up to ``? #``.

    A-Z of the host are lower-cased. Null or without ``://``: both empty.
    """
    found = _URL.match(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


class Trie:
    """Nodes are dicts: host labels from the top domain down, then path segments.

    Under the key ``PATHS`` of a host node hangs the trie of its paths. There, a
    rule's whole segments (each with the slash that ends it) are edges; what is
    left after the last slash is kept in ``TAILS`` and compared as a prefix.
    """

    PATHS, TAILS = "/paths", "/tails"

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *segments, tail = re.split(r"(?<=/)", path)
            for segment in segments:
                node = node.setdefault(segment, {})
            tails = node.setdefault(self.TAILS, {})
            if tails.get(tail, ("", ""))[1] != "block":
                tails[tail] = (f"{host.translate(_UPPER)}{path}", verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        best, node, segments = None, self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if self.PATHS in node:
                segments = re.split(r"(?<=/)", path) if segments is None else segments
                best = self._path(node[self.PATHS], segments) or best
        return best

    def _path(self, node: dict, segments: Sequence[str]) -> tuple[str, str] | None:
        best, at = None, 0
        while node is not None:
            rest = segments[at] if at < len(segments) else ""
            fits = [t for t in node.get(self.TAILS, ()) if rest.startswith(t)]
            if fits:
                best = node[self.TAILS][max(fits, key=len)]
            node, at = (node.get(rest) if rest.endswith("/") else None), at + 1
        return best


def _parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """Judge every url: id, host, path, rule (``host`` + ``path`` or null), verdict.

    One row per row of ``pages``, repeated rows too. Null and malformed urls have
    an empty host and path and get ``default``, as do urls that no rule fits.
    Other columns of ``pages`` are not read. An empty rule table fits nothing.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "host", "path")
        few = rules.limit(max_trie_rules + 1).collect()
        if len(few) > max_trie_rules:
            return _by_join(urls, rules, id_col, default)
        rules = [tuple(r) for r in few]
    elif len(rules) > max_trie_rules:
        spark = pages.sparkSession
        return _by_join(urls, spark.createDataFrame(list(rules), "verdict string, host string, path string"), id_col, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    kind = pages.schema[id_col].dataType.simpleString()

    def judge(batch: pa.RecordBatch) -> dict:
        match = trie.value.match
        hosts, paths, found, verdicts = [], [], [], []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule, verdict = match(host, path) or (None, default)
            hosts.append(host)
            paths.append(path)
            found.append(rule)
            verdicts.append(verdict)
        return {id_col: batch.column(0), "host": hosts, "path": paths, "rule": found, "verdict": verdicts}

    arrow = pa.schema([(id_col, pa.int64() if kind == "bigint" else pa.string())] + [(c, pa.string()) for c in ("host", "path", "rule", "verdict")])
    if kind != "bigint":
        urls = urls.withColumn("id", F.col("id").cast("string"))
    out = arrow_map(urls, f"{id_col} {'bigint' if kind == 'bigint' else 'string'}, host string, path string, rule string, verdict string", judge, arrow)
    return out if kind == "bigint" else out.withColumn(id_col, F.col(id_col).cast(kind))


def _by_join(urls: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same for any number of rules.

    Each distinct (host, path) yields its host suffixes times its paths cut after
    a slash; those meet the rules on (host, whole segments), and what is left of
    a rule's path is compared as a prefix.
    """
    host, path = _parts(F.col("url"))
    base = urls.select("id", host.alias("host"), path.alias("path"))
    keyed = rules.select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r_host"),
        F.regexp_extract("path", r"^([\s\S]*/)", 1).alias("r_dir"),
        F.col("path").alias("r_path"),
        "verdict",
    ).groupBy("r_host", "r_dir", "r_path").agg(F.max("verdict").alias("r_verdict"))  # block > allow
    labels, parts = F.split("host", r"\."), F.split("path", "(?<=/)")
    pairs = materialise(base.groupBy("host", "path").agg(F.count("*").alias("n")), "pairs")
    tries = (
        pairs.select("host", "path")
        .withColumn("r_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
        .withColumn("r_dir", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.regexp_extract(F.array_join(F.slice(parts, F.lit(1), i), ""), r"^([\s\S]*/)", 1)))))
    )
    best = (
        tries.join(keyed, ["r_host", "r_dir"]).filter(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    )
    judged = materialise(pairs.join(best, ["host", "path"], "left").select("host", "path", "n", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict")), "judged")
    # one pair, that of all malformed urls for example, may have a large part of the rows
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    discard(pairs)
    return join_by_size(base, judged, ["host", "path"], "n", total).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
