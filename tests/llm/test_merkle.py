"""The Merkle manifest against one that is built whole."""

from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def levels_of(nodes):
    """All levels of one tree, from the leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([h("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return out


def climb(levels, at, node):
    """What ``node`` in the place of leaf ``at`` leads to, and the siblings on the way."""
    others = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        others += run[: at - first] + run[at - first + 1 :]
        node = h("".join(run[: at - first] + [node] + run[at - first + 1 :]))
        at //= 16
    return node, others


def brute(docs, tampers):
    def leaf(r, text):
        values = [None if v is None else str(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)]
        return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    trees = {}
    for r in docs.collect():
        lowered = r.text and "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        own = leaf(r, r.text)
        changed = leaf(r, lowered) if tampers and r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0 else own
        trees.setdefault((r.source is not None, (r.source or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, own, changed, r.doc_id))
    whole, names = {k: levels_of([x[2] for x in sorted(v)]) for k, v in trees.items()}, sorted(trees)
    upper, out = levels_of([whole[k][-1][0] for k in names]), []
    for i, k in enumerate(names):
        for at, (_, _, own, changed, doc_id) in enumerate(sorted(trees[k])):
            node, others = climb(whole[k], at, changed)
            folded, more = climb(upper, i, node)
            out.append((doc_id, own, whole[k][-1][0], upper[-1][0], h("".join(others + more)), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


def run(docs, tampers=True):
    columns = [F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in merkle.COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(columns)) if tampers else None
    out = merkle.manifest(docs, tampered)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 3))
def test_walk_gives_every_leaf_its_runs(n, levels):
    leaves = [h(str(i)) for i in range(n)]
    whole = [leaves]
    for _ in range(levels):
        whole.append([h("".join(whole[-1][i : i + 16])) for i in range(0, len(whole[-1]), 16)])
    for i, runs in enumerate(merkle.traverse(leaves, levels)):
        for level, run in enumerate(runs):
            first = (i >> 4 * level) // 16 * 16
            assert run == whole[level][first : first + 16]
    if n <= 16**levels:
        assert merkle.block_root(leaves, levels) == whole[levels][0]


def test_walk_holds_few_nodes():
    most = 0

    class Counted(merkle.Treehash):
        def push(self, node):
            nonlocal most
            super().push(node)
            most = max(most, sum(map(len, self.waiting)))

    held, merkle.Treehash = merkle.Treehash, Counted
    try:
        for _ in merkle.traverse([h(str(i)) for i in range(4096)], 3):
            pass
    finally:
        merkle.Treehash = held
    assert most <= 16 * 3


def test_special_rows(spark, special):
    docs = special.unionByName(special.filter("text = 'same text'"))
    assert run(docs) == brute(docs, True)
    assert all(r[-1] for r in run(docs, tampers=False))


def test_blocks_of_several_rounds(spark):
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id") % 100).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("s"), (F.col("id") % 8 == 0).cast("int"))).alias("source"), F.lit(7).cast("long").alias("n_chars"),
    )
    assert run(docs) == brute(docs, True)


def test_many_trees(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("A").alias("text"), F.lit(None).cast("string").alias("lang"),
        F.col("id").cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    assert run(docs) == brute(docs, True)


@pytest.mark.parametrize("rows", [0, 1])
def test_small_tables(special, rows):
    docs = special.limit(rows)
    assert run(docs) == brute(docs, True)


def test_groups_beyond_the_broadcast(special, monkeypatch):
    monkeypatch.setattr(merkle, "FEW_TREES", 0)
    assert run(special) == brute(special, True)
