"""Packing, the ORC store, byte-level BPE and token rollups."""

import hashlib
import os
import random
import time
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, packing, token_rollup, token_store, wordtok
from quarry.llm.queries import RANKS, WORDS, tokenizer_path

PATH = tokenizer_path(WORDS)
LIB = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return crc32(np.array(ids, "<u4").tobytes())


ALPHABET = st.text(alphabet="abSTte'  \n\t\r.,!?01_<|>éÉÿŸßſĸŉ×÷ÀĀāĲØøıİ̱Σσς\x1c\x0b\x00ªº²日", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=6))
def test_word_encoder_is_exact(texts):
    for cache in (100_000, 3):
        assert [x.tolist() for x in _encoder(cache).batch(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


_held = {}


def _encoder(cache):
    if cache not in _held:
        _held[cache] = wordtok.WordEncoder(PATH, cache)
    return _held[cache]


def test_word_encoder_cuts_long_texts(monkeypatch):
    monkeypatch.setattr(wordtok, "SLICE_CHARS", 50)
    texts = ["It's a <|endoftext|> test, of 123 words\n" * 20, "x" * 500, "ab " * 100]
    assert [x.tolist() for x in _encoder(100_000).batch(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(docs, rows, tiers=packing.TIERS):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    total = Counter()
    sequences = {}
    for r in rows:
        total[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append(r)
    want = Counter()
    for i, t in texts:
        want[i] += len(ids_of(t))
    assert total == want
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens <= tiers[-1]
    return sequences


def test_packing(spark, special, nothing):
    rows = packing.pack_documents(special, PATH).collect()
    sequences = check_pieces(special, rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for r in rows:
        if r.doc_id == 3:
            ids = ids_of("x " * 30_000)
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
    own = sorted((r.start, r.length) for r in rows if r.doc_id == 3)
    assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
    assert sum(s[0].sequence_tokens != s[0].tier for s in sequences.values()) <= special.rdd.getNumPartitions()
    assert packing.pack_documents(nothing, PATH).collect() == []
    with_ids = packing.pack_documents(special, PATH, emit_ids=True).collect()
    assert all(crc(r.ids) == r.ids_crc32 for r in with_ids)


def test_packing_in_small_blocks(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(["word"] * rng.choice([0, 5, 60, 300, 1500, 5000]))) for i in range(300)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(docs, PATH, block_tokens=5000).collect()
    sequences = check_pieces(docs, rows)
    assert sum(s[0].sequence_tokens not in packing.TIERS for s in sequences.values()) <= 1
    groups = {}
    for s in sequences.values():
        groups.setdefault(s[0].step_group, []).append(s[0].tier)
    assert all(sum(g) <= packing.STEP_TOKENS for g in groups.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20_000), max_size=60))
def test_pack_covers_each_id_once(lengths):
    windows = packing.pack(lengths)
    seen = {}
    for tier, pieces in windows:
        assert tier in packing.TIERS and 0 < sum(n for _, _, n in pieces) <= tier
        for d, at, n in pieces:
            seen.setdefault(d, []).append((at, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen.get(d, [])):
            assert start == at
            at += size
        assert at == n
    assert sum(sum(n for _, _, n in p) < t for t, p in windows) <= 1


def test_balance_levels_costs():
    costs = [random.Random(1).randrange(1000) for _ in range(80)]
    *groups, rest = packing.balance(costs, 8)
    sums = [sum(costs[i] for i in g) for g in groups]
    assert sorted(i for g in [*groups, rest] for i in g) == list(range(80)) and len(rest) == 0
    assert max(sums) - min(sums) < max(costs)


def test_token_store(spark, special, nothing, tmp_path):
    path = str(tmp_path / "ids")
    token_store.write_ids(special, path, PATH)
    rows = token_store.digests(spark, path).collect()
    docs = sorted(((r.doc_id, r.text) for r in special.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t in docs:
        ids = ids_of(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    again = token_store.read_ids(spark, path, doc_ids=[8]).collect()
    assert [(r.doc_id, r.ids) for r in again] == [(8, ids_of("<|endoftext|> it's 12,34!!"))]
    assert {r.doc_id for r in token_store.read_ids(spark, path, low=2, high=3).collect()} == {2, 3}
    plan = token_store.read_ids(spark, path, doc_ids=[8])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [8])" in plan or "EqualTo(doc_id,8)" in plan
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert files and all(orc.ORCFile(f"{path}/{f}").compression == "ZSTD" for f in files)
    token_store.write_ids(nothing, str(tmp_path / "none"), PATH)
    assert token_store.digests(spark, str(tmp_path / "none")).collect() == []


def test_bpe(spark, special, nothing):
    enc = bpe.encoding(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    rows = bpe.encode_documents(special, tokenizer_path(RANKS), public_tokenizers.PATTERN).collect()
    texts = Counter((r.doc_id, r.text or "") for r in special.collect())
    want = Counter()
    for (i, t), n in texts.items():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in rows) == want
    assert bpe.encode_documents(nothing, tokenizer_path(RANKS), public_tokenizers.PATTERN).count() == 0
    whole = bpe.encode_documents(special, tokenizer_path(RANKS), public_tokenizers.PATTERN, emit="ids").filter("doc_id = 6").first()
    assert bytes(whole.decoded).decode() == "Ünïcödé ’quotes’ ́ 日本語 text"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sZ  \n\t.,!?09é日\x85\x1c", max_size=200), st.integers(1, 20))
def test_safe_pieces(text, size):
    enc = bpe.encoding(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    assert "".join(bpe.safe_pieces(text, size)) == text
    assert bpe.encode(enc, text, size).tolist() == enc.encode_ordinary(text)


def test_rollup(spark, special, nothing, tmp_path):
    counters = {"w": token_rollup.words_counter(PATH)}
    columns = {"chars": F.length("text")}
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().collect() == []
    assert rollup.upsert("a", token_rollup.count_tokens(special, counters, columns))
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}

    def want(docs):
        out = {}
        for i, (text, lang, source) in docs.items():
            for name, n in (("w", len(ids_of(text)) - 1), ("chars", len(text or ""))):
                d, t = out.get((source, lang, name), (0, 0))
                out[source, lang, name] = (d + 1, t + n)
        return out

    docs = {}
    for r in special.collect():
        old = docs.get(r.doc_id)
        if old is None or (r.source or "", r.lang or "") > (old[2] or "", old[1] or ""):
            docs[r.doc_id] = (r.text, r.lang, r.source)
    assert total() == want(docs)
    assert not rollup.upsert("a", token_rollup.count_tokens(special, counters, columns))
    assert total() == want(docs)
    revised = spark.createDataFrame([(2, "a b c", "en", "t"), (99, "new", "en", "t")], "doc_id long, text string, lang string, source string")
    rollup.upsert("b", token_rollup.count_tokens(revised, counters, columns))
    docs |= {2: ("a b c", "en", "t"), 99: ("new", "en", "t")}
    assert total() == want(docs)
    rollup.delete("c", spark.createDataFrame([(3,), (3,), (12345,), (None,)], "doc_id long"))
    del docs[3]  # no id finds the row without one
    assert total() == want(docs)
    rollup.upsert("d", token_rollup.count_tokens(nothing, counters, columns))
    assert total() == want(docs)
    os.remove(tmp_path / "r/rollup/batch=c/_SUCCESS")  # the batch broke off
    assert rollup.delete("c", spark.createDataFrame([(3,), (None,)], "doc_id long"))
    assert total() == want(docs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_rollup_query_with_real_tokenizers(spark):
    from quarry.llm.queries import op9_token_rollup

    tables = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels")}
    toxic = {r.doc_id for r in tables["labels"].filter("toxic = 1").collect()}
    enc = bpe.encoding(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    want = Counter()
    docs = Counter()
    for r in tables["documents"].collect():
        if r.doc_id in toxic:
            continue
        text = "\n".join(x for x in r.text.split("\n") if not x.startswith("Licensed under"))
        for name, n in (("word_bpe_49k", len(ids_of(text)) - 1), ("byte_bpe_50k", len(enc.encode_ordinary(text)))):
            want[r.source, r.lang, name] += n
            docs[r.source, r.lang, name] += 1
    got = op9_token_rollup(spark, "/root/testdata/sf0.001").collect()
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in got} == {k: (docs[k], want[k]) for k in docs}


def test_rollup_counts_every_row_without_an_id(spark, tmp_path):
    rows = [(None, "a b", "en", "s"), (None, "a b", "en", "s"), (None, "c", "en", "s"), (1, "x", "en", "s"), (1, "x", "en", "s"), (1, "y z", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    counts = token_rollup.count_tokens(docs, {}, {"words": F.size(F.split("text", " "))})
    rollup.upsert("a", counts)
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(5, 2 + 2 + 1 + 1 + 2)]
    rollup.upsert("b", counts.filter("doc_id = 1").withColumn("tokens", F.lit(7).cast("long")).limit(1))
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(4, 5 + 7)]


def test_rollup_has_one_writer(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    with rollup._writing(), pytest.raises(RuntimeError, match="another writer"):
        token_rollup.TokenRollup(spark, str(tmp_path / "r")).delete("x", spark.range(1).withColumnRenamed("id", "doc_id"))
    assert rollup.delete("x", spark.range(1).withColumnRenamed("id", "doc_id"))


def test_rollup_s_lease_ends(spark, tmp_path, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    ids = spark.range(1).withColumnRenamed("id", "doc_id")
    rollup.delete("x", ids)
    (tmp_path / "r/_writer").touch()  # a writer that died
    with pytest.raises(RuntimeError, match="another writer"):
        rollup.delete("y", ids)
    os.utime(tmp_path / "r/_writer", (1, 1))
    assert rollup.delete("y", ids) and not (tmp_path / "r/_writer").exists()
    monkeypatch.setattr(token_rollup, "LEASE", 0.6)
    with rollup._writing():  # a living writer renews its lease
        time.sleep(1.5)
        with pytest.raises(RuntimeError, match="another writer"):
            rollup.delete("z", ids)


def test_rollup_merges_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "MERGE_AT", 3)
    rollup, want = token_rollup.TokenRollup(spark, str(tmp_path / "r")), {}
    for step in range(10):
        ids = [step % 4, 10 + step]
        if step in (4, 7):
            rollup.delete(f"b{step}", spark.createDataFrame([(i,) for i in ids], "doc_id long"))
            for i in ids:
                want.pop(i, None)
        else:
            rows = [(i, "s", None, "w", 1, 100 * step + i) for i in ids]
            rollup.upsert(f"b{step}", spark.createDataFrame(rows, token_rollup.LEDGER))
            want |= {r[0]: r[5] for r in rows}
        assert {r.doc_id: r.tokens for r in rollup.ledger().collect()} == want
        assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(len(want), sum(want.values()))]
        assert len(rollup._parts()) <= 5
    assert rollup.committed() == sorted(f"b{i}" for i in range(10))
    assert not rollup.upsert("b3", spark.createDataFrame([], token_rollup.LEDGER))
    rollup.vacuum()
    assert len(os.listdir(tmp_path / "r/ledger")) == len(rollup._parts()) < 6
    assert {r.doc_id: r.tokens for r in rollup.ledger().collect()} == want and rollup.committed() == sorted(f"b{i}" for i in range(10))


def test_token_store_of_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(7, "the same text")] * 400 + [(7, "other")], "doc_id long, text string").repartition(4)
    rows = token_store.round_trip(docs, PATH).orderBy("start").collect()
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1]) and len(rows) == 401


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    from tokenizers import models, normalizers, pre_tokenizers

    other = Tokenizer(models.WordLevel({"It's": 0, "?": 1, "12": 2, "A": 3}, unk_token="?"))
    other.pre_tokenizer, other.normalizer = pre_tokenizers.WhitespaceSplit(), normalizers.NFC()
    path = str(tmp_path / "other.json")
    other.save(path)
    texts = ["It's 12 A a", "", "x" * 50]
    assert [x.tolist() for x in wordtok.WordEncoder(path).batch(texts)] == [other.encode(t).ids for t in texts]
    assert wordtok.WordEncoder(path).ids(texts[0]).tolist() == other.encode(texts[0]).ids
    assert _encoder(100_000).by_words


def test_other_patterns_are_not_cut():
    pattern = r"\w+|[^\w\s]+[\r\n ]*|\s+"
    enc = bpe.encoding(tokenizer_path(RANKS), pattern)
    text = "one, \n\n two. \n three! " * 40
    assert bpe.encode(enc, text, 10).tolist() == enc.encode_ordinary(text)
    assert public_tokenizers.PATTERN in bpe.SAFE_PATTERNS


def test_very_long_texts(spark):
    """Beyond the sizes at which texts are cut, one of them without a space."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(200_000)), "ab1" * 120_000]
    assert len(texts[0]) > wordtok.SLICE_CHARS and len(texts[1]) > bpe.SPLIT_CHARS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [ids_of(t) for t in texts]
    pieces = packing.pack_documents(docs, PATH).collect()
    assert all(crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in pieces)
    assert Counter({r.doc_id: r.doc_tokens for r in pieces}) == {i: len(x) for i, x in enumerate(ids)}
    enc = bpe.encoding(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    for r in bpe.encode_documents(docs, tokenizer_path(RANKS), public_tokenizers.PATTERN).collect():
        want = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_token_store_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_store.write_ids(docs, path, PATH)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (file,) = [f"{path}/{f}" for f in os.listdir(path) if f.endswith(".orc")]
    jvm = spark._jvm
    orc_file = jvm.org.apache.orc.OrcFile
    reader = orc_file.createReader(jvm.org.apache.hadoop.fs.Path(file), orc_file.readerOptions(spark._jsc.hadoopConfiguration()))
    rows = reader.rows()
    kinds = {str(s.getKind()) for s in rows.readStripeFooter(reader.getStripes().get(0)).getStreamsList()}
    rows.close()
    assert "ROW_INDEX" in kinds and "BLOOM_FILTER_UTF8" in kinds
    plan = spark.read.schema(token_store.SCHEMA).orc(path).filter("doc_id = 4321")._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().get("numOutputRows").get().value() == token_store.ROW_INDEX


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_registered_queries_by_their_contracts(spark):
    """op1, op5, op6 and op8 on the smallest tables, against the libraries."""
    from quarry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    ids = {i: ids_of(t) for i, t in docs}
    whole: dict = {}
    windows: dict = {}
    for r in QUERIES["op1_packing"](spark, sf).collect():
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        whole.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, most in [(p, len(ids[i])) for i, p in whole.items()] + [(w, None) for w in windows.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == most if most else at <= 4096
    assert whole.keys() == ids.keys()
    at, want = 0, []
    for i, _ in docs:
        want.append((i, at, len(ids[i]), crc(ids[i])))
        at += len(ids[i])
    assert sorted(map(tuple, QUERIES["op5_token_store"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
    enc = bpe.encoding(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    for r in QUERIES["op6_byte_bpe"](spark, sf).collect():
        own = np.array(enc.encode_ordinary(dict(docs)[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(own.tobytes()).hexdigest())
    media = {r.doc_id: r for r in QUERIES["op8_media"](spark, sf).collect()}
    assert media.keys() == ids.keys()
    for i, t in docs:
        content = t.encode()
        payload = content + bytes(-len(content) % 64 or (0 if content else 64))
        r = media[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(content), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]))
