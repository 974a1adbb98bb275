"""Exact dedup, the n-gram join, components and the pipeline."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, exact_dedup, ngram_join
from quarry.llm.components import components

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture
def small_hot(monkeypatch):
    """Groups count as hot from three rows on."""
    monkeypatch.setattr(exact_dedup, "hot_keys", lambda rows, key, total: [r["k"] for r in rows.groupBy(key.alias("k")).count().filter("count > 2").collect()])


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out[i, keep, len(own), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def check_exact(docs, block):
    rows = exact_dedup.exact_dedup(docs, block=block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute_exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) <= {1} and len(kept) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_special(special, nothing, block):
    check_exact(special.filter("doc_id <> 3 OR doc_id IS NULL") if block == 4 else special, block)
    assert exact_dedup.exact_dedup(nothing, block=block).count() == 0
    left = exact_dedup.drop_copies(special)
    assert left.columns == special.columns
    assert sorted(Counter(r.text or "" for r in left.collect()).values())[-1] == 1


def test_exact_with_hot_blocks(spark, small_hot):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    check_exact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2)


def test_exact_with_large_groups(spark):
    rows = [(i, "copy of a text") for i in range(1500)] + [(i, f"text {i % 40}") for i in range(1500, 1700)]
    check_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8)


def test_names_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7} " * 9) for i in range(50)], "doc_id long, text string")
    a = exact_dedup.identities(docs.repartition(2), block=8).select("doc_id", "level", "name").collect()
    b = exact_dedup.identities(docs.repartition(5), block=8).select("doc_id", "level", "name").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_native_plan(special):
    plan = exact_dedup.exact_dedup(special.filter("doc_id < 3"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- n-gram join


def test_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.999, 25)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands <= 25
    assert 1 - (1 - 0.8 ** (rows + 1)) ** 25 < 0.999


def brute_join(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            shared = len(a & b)
            if (not a and not b) or (a and b and shared >= threshold * (len(a) + len(b) - shared) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(i)
    return links, list(classes.values())


def check_join(docs, result=None, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    links, classes = brute_join(rows)
    got = (ngram_join.similar_documents(docs, **options) if result is None else result).collect()
    first = lambda c: min((rows[i][0] for i in c), key=lambda x: (x is not None, x))  # noqa: E731  nulls first
    want = Counter((rows[i][0], first(c), links[i], len(c)) for c in classes for i in c)
    assert Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(classes)


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_join_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 30, 120, 300]))]
        rows += [near(rng, base, rng.randrange(0, 4)) for _ in range(rng.choice([1, 2, 5, 12]))]
        rows.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    check_join(docs, recall=0.99999)
    check_join(docs, recall=0.99999, block=3)  # groups of several blocks


def test_join_of_tight_groups(spark):
    """Groups whose members are mostly close to the pivot, with others further off and copies."""
    rng = random.Random(11)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(250)]
        rows += [near(rng, base, 1) for _ in range(15)] + [near(rng, base, 3) for _ in range(6)] + [" ".join(base)] * 3
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for block in (2, 5, 512):
        check_join(docs, recall=0.99999, block=block)


def test_bands_of_the_query_meet_just_above_the_threshold():
    rng = np.random.default_rng(3)
    sh = ngram_join.shingler(ngram_join.N, *ngram_join.choose_bands())
    missed = 0
    for i in range(20_000):
        size = (10, 20, 50)[i % 3]  # of the union; four fifths of it are shared
        both = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
        shared = size * 4 // 5
        half = shared + (size - shared) // 2
        a, b = both[:half], np.concatenate([both[:shared], both[half:]])
        missed += not (sh.band_hashes(a) == sh.band_hashes(b)).any()
    assert missed <= 2  # a tenth of a thousandth; with 0.999 it would be about twenty


def test_join_special(special, nothing):
    check_join(special)
    assert ngram_join.similar_documents(nothing).count() == 0
    left = ngram_join.drop_similar(special)
    assert left.columns == special.columns
    assert left.count() == ngram_join.similar_documents(special).filter("kept").count()


@needs_data
def test_join_on_the_test_tables(spark):
    from quarry.llm.queries import QUERIES

    check_join(spark.read.parquet(f"{DATA}/documents.parquet"), QUERIES["op10_ngram_join"](spark, DATA))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)] + [(300, 300 + k) for k in range(1, 50)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_do_not_converge(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.components.MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="2 rounds"):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"))


def test_clashing_columns(spark, special):
    names = ["__id", "__own", "__sha", "__one", "__key", "file", "At", "_file", "row", "word", "bitmap", "flag", "place", "_metadata", "text_key"]
    docs = special.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    for left in (exact_dedup.drop_copies(docs), ngram_join.drop_similar(docs)):
        rows = left.collect()
        assert left.columns == docs.columns and rows
        assert all(r[n] == n for r in rows for n in names)


def test_many_rows_with_one_id_and_text(spark):
    docs = spark.range(0, 100_000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text of seven words in all").alias("text"))
    for left in (exact_dedup.drop_copies(docs), ngram_join.drop_similar(docs)):
        assert left.count() == 1
    assert ngram_join.similar_documents(docs).filter("n_links = 99999 AND class_size = 100000").count() == 100_000


def test_join_in_blocks_of_few_ngrams(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(250)]
    rows = [near(rng, base, e) for e in (0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6)] + [" ".join(base)] * 2
    check_join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), block_grams=600)


def test_bitmaps_and_places(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 3000, 1, 3).withColumn("v", F.col("id") % 7).write.parquet(path)
    table = spark.read.parquet(path)
    keys = table.filter("id % 11 = 0").select("id")
    flagged = common.among(table, ["id"], keys, "f").filter("f")
    assert flagged.columns == ["id", "v", "f"] and keys.count() <= flagged.count() < 1.2 * keys.count()
    assert flagged.join(keys, "id").count() == keys.count()
    assert sorted(r.id for r in common.without(table, ["id"], keys).collect()) == [i for i in range(3000) if i % 11]
    assert common.without(table, ["id"], keys.limit(0)).count() == 3000
    placed, *where = common.located(table, True)
    assert placed.select(*where).distinct().count() == 3000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # other partitions, the same places
    try:
        again, *_ = common.located(spark.read.parquet(path), True)
        assert placed.join(again, [*where, "id"]).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_join_salted(spark):
    facts = spark.range(5000).select((F.col("id") % 2).alias("k"), "id", F.lit(2500).cast("long").alias("n"))
    dim = facts.groupBy("k").agg(F.max("id").alias("m"), F.max("n").alias("n"))
    got = common.join_salted(facts, dim, "k", "n", "id")
    assert got.count() == 5000 and got.filter("m % 2 <> k").count() == 0


def test_join_by_size(spark):
    facts = spark.createDataFrame([(i % 3, i) for i in range(6000)], "k long, v long")
    dim = facts.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = common.join_by_size(facts, dim, ["k"], "n", 6000)
    assert got.count() == 6000 and got.filter("m < v").count() == 0


# -- pipeline


@needs_data
def test_pipeline(spark):
    import corpus_pipeline
    from quarry.llm import quality, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, left = docs.columns, docs
    wide = docs.withColumn("__extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left
        left = stage(spark, before, DATA)
        assert left.columns == columns, name
        rows = [tuple(r) for r in left.collect()]
        assert not Counter(rows) - Counter(tuple(r) for r in before.collect())
        left = spark.createDataFrame(rows, before.schema)
        if name == "toxicity":
            assert {r[0] for r in rows} == {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("not toxic").collect()}
        if name == "quality":
            assert {r[0] for r in rows} == {r.doc_id for r in quality.score(before, quality.fit(before, labels)).filter("predicted = 1").collect()}
        if name == "exact_dedup":
            assert len(rows) == len({r.text for r in before.collect()})
        if name == "ngram_join":
            assert len(rows) == len(brute_join([(r.doc_id, r.text) for r in before.collect()])[1])
        assert stage(spark, wide.limit(0), DATA).columns == wide.columns
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in left.collect()}
