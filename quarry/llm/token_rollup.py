"""Token counts as delta-maintained rollups.

Every change is a batch with a name: inserts and revisions add the new count and
take back the one that stood before, deletes take back. A batch becomes

    ledger/batch=NAME/   signed rows per document and tokenizer version
    rollup/batch=NAME/   their sums by source, language and tokenizer version

and is committed when the second folder is complete. Folders of a batch belong to
it alone: a batch that broke off is simply written again, and one that is
committed is skipped, so sending a batch twice changes nothing. Totals are the
sums over committed batches; no stored total is ever rewritten.

Eight batches are merged into one part, eight such parts into a larger one, and so
on, where rows that cancel each other go; so a look into the ledger reads a number of
parts that is logarithmic in the number of batches. ``merged-N.json`` says which part
stands for which batches; the highest N counts.

One writer works at a time. It holds a lease that it renews while it works; the lease
of a writer that died ends by itself after LEASE seconds.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, discard, materialise, only, text_of

KEYS = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
ROLLUP = "source string, lang string, tokenizer string, docs long, tokens long"

#: Parts of one level that are merged, and seconds after which a lease that isn't renewed ends.
MERGE_AT, LEASE = 8, 600.0

#: A version's counter: counts for a list of texts, or a column of the text.
Counter = Callable[[list], list] | Callable[[Column], Column]


def words_counter(path: str) -> Callable[[list], list]:
    """Counts with a ``tokenizers`` file that drops white space."""

    def count(texts: list) -> list:
        from quarry.llm.wordtok import encoder

        return [len(ids) for ids in encoder(path).batch(texts)]

    return count


def bytes_counter(path: str, pattern: str) -> Callable[[list], list]:
    """Counts with a tiktoken rank file."""

    def count(texts: list) -> list:
        from quarry.llm.bpe import encode, encoding

        return [len(encode(encoding(path, pattern), t)) for t in texts]

    return count


def count_tokens(
    docs: DataFrame, counters: Mapping[str, Callable[[list], list]], columns: Mapping[str, Column] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """doc_id, source, lang, tokenizer, docs, tokens of every whole text (null: empty).

    ``columns`` are further versions, each a column expression over ``text``. A row
    that repeats another in id, source, lang and text counts once; rows of one id
    that differ are documents of their own, which are revised and deleted together.
    Rows without an id are all counted, repeats too. Null sources and languages are
    keys of their own; an empty table gives no row; other columns aren't read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), text_of(text_col).alias("text"))
    base = base.withColumn("own", F.xxhash64("text"))
    names = list(counters)

    def rows(batch: pa.RecordBatch) -> dict:
        texts = batch.column(3).to_pylist()
        each = [counters[name](texts) for name in names]
        return {"doc_id": batch.column(0), "source": batch.column(1), "lang": batch.column(2), "own": batch.column(4), "counts": [list(c) for c in zip(*each, strict=True)]}

    parts = []
    if names:
        arrow = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("own", pa.int64()), ("counts", pa.list_(pa.int64()))])
        counted = arrow_map(base, "doc_id long, source string, lang string, own long, counts array<long>", rows, arrow)
        label = F.array(*[F.lit(n) for n in names])
        parts.append(counted.select("doc_id", "source", "lang", "own", F.explode(F.arrays_zip(label.alias("tokenizer"), F.col("counts").alias("tokens"))).alias("c")).select("doc_id", "source", "lang", "own", F.col("c.tokenizer").alias("tokenizer"), F.col("c.tokens").alias("tokens")))
    for name, column in (columns or {}).items():
        parts.append(base.select("doc_id", "source", "lang", "own", F.lit(name).alias("tokenizer"), column.cast("long").alias("tokens")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    one = out.groupBy("doc_id", *KEYS, "own").agg(F.when(F.col("doc_id").isNull(), F.count("*")).otherwise(1).alias("docs"), F.max("tokens").alias("tokens"))
    return one.select("doc_id", *KEYS, "docs", (F.col("tokens") * F.col("docs")).alias("tokens"))


class TokenRollup:
    """The rollup kept below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, where: str) -> list[str]:
        fs, path = self._fs(where)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _merged(self) -> tuple[int, list[dict]]:
        """The number and the content of the newest list of merged parts: name, level, batches."""
        n = max((int(x[7:-5]) for x in self._names(self.path) if x.startswith("merged-") and x.endswith(".json")), default=0)
        if not n:
            return 0, []
        fs, path = self._fs(f"{self.path}/merged-{n}.json")
        stream = fs.open(path)
        try:
            return n, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def committed(self) -> list[str]:
        """Names of the committed batches."""
        names = [n.removeprefix("batch=") for n in self._names(f"{self.path}/rollup") if n.startswith("batch=")]
        fs, _ = self._fs(self.path)
        done = {n for n in names if fs.exists(self._fs(f"{self.path}/rollup/batch={n}/_SUCCESS")[1])}
        return sorted(done.union(*[p["batches"] for p in self._merged()[1]]))

    def _parts(self) -> list[dict]:
        """Merged parts, and batches as parts of level 0, that make up the rollup."""
        merged = self._merged()[1]
        covered = {b for p in merged for b in p["batches"]}
        return merged + [{"name": f"batch={b}", "level": 0, "batches": [b]} for b in self.committed() if b not in covered]

    def _read(self, kind: str, schema: str, parts: list[dict] | None = None) -> DataFrame:
        held = [f"{self.path}/{kind}/{p['name']}" for p in (self._parts() if parts is None else parts)]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def _merge(self) -> None:
        """Merge parts where there are enough of a level; readers see the old parts or the new one."""
        while True:
            parts, levels = self._parts(), {}
            for p in parts:
                levels.setdefault(p["level"], []).append(p)
            full = next((levels[k] for k in sorted(levels) if len(levels[k]) >= MERGE_AT), None)
            if full is None:
                return
            name = f"merged={uuid.uuid4().hex}"
            sums = [F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")]
            for kind, schema, keys in (("ledger", LEDGER, ("doc_id", *KEYS)), ("rollup", ROLLUP, KEYS)):
                one = self._read(kind, schema, full).groupBy(*keys).agg(*sums).filter("docs <> 0 OR tokens <> 0")
                one.write.parquet(f"{self.path}/{kind}/{name}")
            n, merged = self._merged()
            gone = {p["name"] for p in full}
            merged = [p for p in merged if p["name"] not in gone] + [{"name": name, "level": full[0]["level"] + 1, "batches": sorted(b for p in full for b in p["batches"])}]
            self._put(f"{self.path}/merged-{n + 1}.json", json.dumps(merged, sort_keys=True))

    def _put(self, where: str, content: str) -> None:
        """Write a file aside and rename it, so that it is there whole or not at all."""
        fs, aside = self._fs(f"{self.path}/_aside-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(content.encode()))
        out.close()
        if not fs.rename(aside, self._fs(where)[1]):
            raise RuntimeError(f"{where} is there already")

    def vacuum(self) -> None:
        """Delete parts that merged ones stand for, and older lists; nobody may be reading them."""
        with self._writing():
            n, merged = self._merged()
            keep = {p["name"] for p in self._parts()}
            for kind in ("ledger", "rollup"):
                for name in self._names(f"{self.path}/{kind}"):
                    if name not in keep:
                        fs, path = self._fs(f"{self.path}/{kind}/{name}")
                        fs.delete(path, True)
            for k in range(1, n):
                fs, path = self._fs(f"{self.path}/merged-{k}.json")
                fs.delete(path, False)

    def ledger(self, ids: DataFrame | None = None) -> DataFrame:
        """What stands now (of the documents in ``ids.doc_id``): doc_id, source, lang, tokenizer, docs, tokens.

        Of the ledger only rows that may be of these documents are shuffled. Rows
        without an id stand in the ledger, and no id finds them.
        """
        signed = self._read("ledger", LEDGER)
        if ids is not None:
            ids = ids.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct()
            signed = only(signed, ["doc_id"], ids).join(ids, "doc_id", "left_semi")
        rows = signed.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.filter("docs > 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys without documents are left out."""
        sums = self._read("rollup", ROLLUP).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """Hold the rollup: a second writer would take back the same rows again."""
        fs, path = self._fs(f"{self.path}/_writer")
        fs.mkdirs(path.getParent())
        try:
            fs.create(path, False).close()
        except Exception as e:
            if not fs.exists(path):
                raise
            since = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
            # of several that find the lease over, one can move it away
            if since < LEASE or not fs.rename(path, self._fs(f"{self.path}/_ended-{uuid.uuid4().hex}")[1]):
                raise RuntimeError(f"another writer holds {self.path}; its lease ends in {max(0, LEASE - since):.0f} s unless it is renewed") from e
            fs.create(path, False).close()
        over = threading.Event()

        def renew() -> None:
            while not over.wait(LEASE / 6):
                fs.setTimes(path, int(time.time() * 1000), -1)

        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            fs.delete(path, False)

    def _commit(self, batch: str, rows: DataFrame) -> bool:
        ledger, rollup = f"{self.path}/ledger/batch={batch}", f"{self.path}/rollup/batch={batch}"
        rows.select("doc_id", *KEYS, "docs", "tokens").write.mode("overwrite").parquet(ledger)
        signed = self.spark.read.schema(LEDGER).parquet(ledger)
        sums = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(rollup)  # one row per key
        self._merge()
        return True

    def upsert(self, batch: str, counts: DataFrame) -> bool:
        """Insert documents or revise their counts; False if the batch is committed already.

        Documents without an id can be inserted only, never revised.
        """
        with self._writing():
            if batch in (held := self.committed()):
                return False
            if held:
                counts = materialise(counts, "counts")  # read three times, counted once
            new = counts.select("doc_id", *KEYS, "docs", "tokens")
            if not held:
                return self._commit(batch, new)
            revised = counts.select("doc_id", "tokenizer").distinct()
            back = self.ledger(counts).join(revised, ["doc_id", "tokenizer"], "left_semi")
            self._commit(batch, new.unionByName(back.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))))
            discard(counts)
            return True

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Take back all counts of the documents in ``ids.doc_id``; unknown and null ids change nothing."""
        with self._writing():
            if batch in self.committed():
                return False
            return self._commit(batch, self.ledger(ids).select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))


def maintain(docs: DataFrame, labels: DataFrame, path: str, counters: Mapping[str, Callable[[list], list]], columns: Mapping[str, Column] | None = None) -> DataFrame:
    """Totals after three batches and one that is sent twice.

    1. all documents are inserted; 2. those with a license line (a line that starts
    with ``Licensed under``) are revised to their text without such lines; 3. those
    that the labels call toxic are deleted; then 2. comes again and is skipped.
    Documents without an id are inserted only.
    """
    rollup = TokenRollup(docs.sparkSession, path)
    rollup.upsert("1-insert", count_tokens(docs, counters, columns))
    licensed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(^|\n)Licensed under"))
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.startswith("Licensed under"))
    revised = licensed.withColumn("text", F.array_join(lines, "\n"))
    rollup.upsert("2-revise", count_tokens(revised, counters, columns))
    rollup.delete("3-delete", labels.filter("toxic = 1").select("doc_id"))
    rollup.upsert("2-revise", count_tokens(revised, counters, columns))
    return rollup.totals()
