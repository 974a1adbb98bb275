"""Lexical search over the clustered index against scores of all documents."""

import random
import re
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import lexical
from quarry.llm.common import scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    held = [(d, words) for d, t in docs if (words := terms(t))]
    n_docs, total, df = len(held), sum(len(w) for _, w in held), {}
    for _, words in held:
        for t in set(words):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        found = []
        for d, words in held:
            m = 100 - 50 + (50 * len(words) * n_docs) // total
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m)) for t in own if (tf := words.count(t)))
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(i, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=50):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("shard", F.lit("clash"))
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("clash"))
    return sorted(map(tuple, lexical.search_documents(docs, items, k).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBZz09 /:@[`{~.,\x00\x7f\x80éÉſİ日\n\t", max_size=60))
def test_terms(text):
    assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


def corpus(seed, n, topics=4):
    rng = random.Random(seed)
    words = [[f"t{i}w{j}" for j in range(60)] for i in range(topics)]
    shared = [f"common{j}" for j in range(20)]
    docs = []
    for i in range(n):
        own = words[i % topics]
        docs.append((i, " ".join(rng.choice(own if rng.random() < 0.8 else shared) for _ in range(rng.randint(1, 80)))))
    return docs


@pytest.mark.parametrize("postings", [50, 400, 200_000])
def test_exact(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    docs = corpus(1, 300)
    docs += [(1000 + i, docs[7][1]) for i in range(70)] + [(5, "t0w1 again")] * 2  # ties beyond k, and an id that repeats
    items = [(i, " ".join(t.split()[:12])) for i, t in docs[:12]] + [(50, docs[7][1]), (51, "common1 COMMON2, t0w1"), (51, "t3w5"), (52, "nowhere"), (53, None)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_special_rows(spark, special, nothing):
    docs = [(r.doc_id, r.text) for r in special.collect()]
    items = [(1, "same text"), (None, "without ID"), (3, ""), (4, "x Ünïcödé 日本語 endoftext")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, [(1, None), (2, " .,")], items) == []
    assert run(spark, docs, []) == []
    assert lexical.search_documents(nothing, nothing.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    docs = corpus(2, 60)
    items = [(i, t) for i, t in docs[:10]]
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(lexical, "FEW_VISITS", 0)
    assert run(spark, docs, items) == brute(docs, items)


def test_cuts_separate_topics():
    rng = np.random.default_rng(5)
    documents = [np.unique(rng.integers(0, 100, 30) + 100 * (i % 4)) for i in range(400)]
    weights = lexical.bisect(documents, 400, depth=2)
    ends = [lexical.route(weights, d) for d in documents]
    assert len(set(ends)) == 4
    assert all(len({e for e, i in zip(ends, range(400)) if i % 4 == topic}) == 1 for topic in range(4))


def test_shards_are_passed_over(spark, monkeypatch):
    """With documents of four topics, an item of one topic needn't visit the others' shards."""
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 1000)
    visits = []
    held = lexical._visited
    monkeypatch.setattr(lexical, "_visited", lambda index, chosen, count, *a: visits.append(count) or held(index, chosen, count, *a))
    docs = corpus(3, 2000)
    items = [(i, " ".join(w for w in t.split() if w[0] == "t")) for i, t in docs[40:48]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    path = scratch(spark, "index")
    lexical.build_index(frame, path)
    index = spark.read.schema(lexical._INDEX).parquet(path)
    found = sorted(map(tuple, lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 5).collect()), key=str)
    assert found == brute(docs, items, 5)
    assert index.agg(F.sum("n_docs")).first()[0] == 2000
    assert sum(visits) < 0.6 * 8 * index.count(), (visits, index.count())
