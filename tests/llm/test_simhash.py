"""Fingerprints, edits and neighbours against versions over all documents at once."""

import random
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.queries import op13_simhash


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def check(docs, out, radius=simhash.RADIUS):
    """``docs``: (doc_id, text) in the order of the files."""
    order = sorted(enumerate(docs), key=lambda x: (x[1][0] is None, -(x[1][0] or 0), x[0]))
    rows = sorted(map(tuple, out.collect()), key=str)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within"]
    prints, want, f = [], [], simhash.Fingerprinter()
    texts = [t or "" for _, (_, t) in order]
    for i, (_, (doc_id, _)) in enumerate(order):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        k = len(text) // 3
        changed = text[: len(text) - k] + following[:k]
        a, b, c = f(text), f(changed), f(following)
        prints.append(a.hex())
        want.append([doc_id, len(text), sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c)])
    for row, own in zip(want, prints, strict=True):
        row.append(sum(bits(own, p) <= radius for p in prints) - 1)
    assert rows == sorted(map(tuple, want), key=str)


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    out = op13_simhash(spark, path)
    check(docs, out)
    near, following = (np.array([r[0] for r in out.select(c).collect()]) for c in ("near_edited", "near_next"))
    assert np.median(near) > 0.6 and np.median(following) < 0.1 and (near > following).mean() > 0.98


def test_special_rows(spark, special, nothing):
    docs = special.filter("doc_id <> 4 OR lang IS NULL").coalesce(1)  # repeated rows are tested below
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.fingerprint_documents(docs))
    assert simhash.fingerprint_documents(nothing).count() == 0
    alone = spark.createDataFrame([(3, "one document only, of some words")], "doc_id long, text string")
    check([(3, "one document only, of some words")], simhash.fingerprint_documents(alone))


def test_blocks_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ORDER_ROWS", 3)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i // 2 if i % 5 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    check(docs, simhash.fingerprint_documents(frame))


def test_equal_texts_and_terms():
    a, b = simhash.Fingerprinter(), simhash.Fingerprinter()
    b("other words first, so that its cache differs")
    text = "some longer text " * 700
    assert a(text) == a(text) == b(text)
    assert a("") == bytes(32) and simhash.likeness(a(""), b("")) == 1.0
    assert simhash.edited("abcdef", "XYZ") == "abcdXY" and simhash.edited("abcdef", "X") == "abcdX" and simhash.edited("ab", "X") == "ab"


@pytest.mark.parametrize(("radius", "blocks", "chunk"), [(7, 8, 1024), (7, 8, 5), (3, 4, 8), (6, 8, 4), (0, 8, 3)])
def test_neighbours(spark, monkeypatch, radius, blocks, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(radius)
    centres = [rng.getrandbits(256) for _ in range(6)]
    found = set(centres)
    for i in range(120):
        x = rng.choice(centres[: 1 + i % 6])
        for _ in range(rng.randint(1, 9)):
            x ^= 1 << rng.randrange(256)
        found.add(x)
    prints = [(f"{x:064x}", rng.randint(1, 3)) for x in found]
    frame = spark.createDataFrame(prints, "fingerprint string, copies long")
    got = {r["fingerprint"]: r["within"] for r in simhash.neighbours(frame, radius, blocks).collect()}
    want = dict.fromkeys((p for p, _ in prints), 0)
    for (a, n), (b, m) in combinations(prints, 2):
        if bits(a, b) <= radius:
            want[a] += m
            want[b] += n
    assert got == {k: v for k, v in want.items() if v}


def test_many_copies(spark, monkeypatch):
    """Copies of one text are counted, and never paired."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the very same words again").otherwise(F.concat(F.lit("text of number "), F.hex("id"))).alias("text"))
    out = simhash.fingerprint_documents(docs)
    assert out.filter("doc_id % 3 = 0").select("n_within").distinct().first()[0] >= 999
    assert out.count() == 3000
