"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all ordered
thresholds theta_1 < theta_2 < ...; the expected severity is the sum of these
probabilities. x holds 1 + log(count) of the words and word beginnings of a
screened vocabulary; beginnings stand for inflected and compound forms.

The vocabulary is screened on all labelled rows, in each language and in all of
them together; a feature enters by its best place in any of these lists, so that a
rare language's words compete with each other only. The weights are fitted on a
bounded sample of the labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN documents, taken
from the languages in turns by the order of a hash of their ids), weighted back to
the labels' true shares. Of labelled documents that share their least word triple
one is used, so that a copied text doesn't pass for evidence about all its words.
Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from quarry.llm.common import arrow_map, discard, join_by_size, keep_rows, located, materialise, only, slices, text_of

SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000
#: Beginnings of these lengths (of longer words) are features, too.
BEGINNINGS = (4, 5, 6, 7)
#: Features enter the vocabulary if at least so many documents of a language have
#: them, and their share among toxic documents differs by so many standard errors.
#: The floor is low, since few documents of a rare language can show a difference;
#: the ridge penalty does the rest.
MIN_DOCUMENTS, MIN_Z, MAX_WORDS = 3, 3.0, 16_384
#: A language's features are ranked in so many slices before they are ranked together.
SLICES = 32
#: Weight of the squared weights, and steps of the fit.
RIDGE, STEPS = 1e-5, 600
#: A task hands on its counts of features when one language has more than so many.
MAX_HELD = 160_000

_WORD = re.compile(r"\w+")
#: Odd numbers that mix the hashes of a word triple.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x7FB5D329728EA185], np.uint64)


def words(text: str) -> Iterable[str]:
    """Lower-cased runs of letters, digits and underscores."""
    text = text.lower()
    return _WORD.findall(text) if len(text) < 1_000_000 else (m.group() for m in _WORD.finditer(text))


def features(text: str) -> Counter:
    """Counts of the words (``word``) and their beginnings (``begin-``)."""
    found = Counter(words(text))
    out = Counter(found)
    for word, n in found.items():
        for k in BEGINNINGS:
            if len(word) > k:
                out[word[:k] + "-"] += n
    return out


def present(text: str) -> set[str]:
    """The features that a text has."""
    found = set(words(text))
    out = set(found)
    for k in BEGINNINGS:
        out.update([word[:k] + "-" for word in found if len(word) > k])
    return out


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, width: int, steps: int = STEPS, ridge: float = RIDGE):
    """(weights, ascending thresholds) by maximum likelihood, from sparse x[rows, cols].

    The thresholds are theta_1 and positive steps (as logarithms) after it, so
    their order holds at every step of the fit.
    """
    n, levels = len(grade), int(grade.max())
    weight = weight / weight.sum()
    share = np.array([(weight * (grade >= k)).sum() for k in range(1, levels + 1)]).clip(1e-6, 1 - 1e-6)
    theta = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(width), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for t in range(1, steps + 1):
        w, gaps = p[:width], np.exp(p[width + 1 :])
        theta = p[width] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.bincount(rows, x * w[cols], n)
        s = np.column_stack([np.ones(n), 1 / (1 + np.exp(-(eta[:, None] - theta).clip(-40, 40))), np.zeros(n)])
        low, high = s[at, grade], s[at, grade + 1]
        chance = np.maximum(low - high, 1e-12)
        d_eta = weight * (1 - low - high)
        d_theta = np.zeros(levels + 2)
        np.add.at(d_theta, grade, -weight * low * (1 - low) / chance)
        np.add.at(d_theta, grade + 1, weight * high * (1 - high) / chance)
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]  # a step moves all thresholds after it
        g = np.concatenate([np.bincount(cols, x * d_eta[rows], width) - 2 * ridge * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return p[:width], p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])


@dataclass
class SeverityModel:
    """Feature weights and thresholds; without thresholds every severity is 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self._names = sorted(self.weights)
        numbers = {name: i for i, name in enumerate(self._names)}
        self._begins = {name[:-1]: i for name, i in numbers.items() if name.endswith("-")}
        self._words = {name: i for name, i in numbers.items() if not name.endswith("-")}
        self._starts = {begin[: min(BEGINNINGS)] for begin in self._begins}

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        known: dict[int, int] = {}
        whole, begins, starts, least = self._words, self._begins, self._starts, min(BEGINNINGS)
        for word, n in Counter(words(text)).items():
            if (i := whole.get(word)) is not None:
                known[i] = known.get(i, 0) + n
            if word[:least] in starts:  # as any of its beginnings' is
                for k in BEGINNINGS:
                    if len(word) > k and (i := begins.get(word[:k])) is not None:
                        known[i] = known.get(i, 0) + n
        eta = sum((1 + log(known[i])) * self.weights[self._names[i]] for i in sorted(known))
        return 1 / (1 + np.exp(-(eta - self.thresholds).clip(-40, 40)))


def _least_triple(text: str) -> int:
    """The least hash of three words in a row (of the whole text if it has fewer)."""
    found = text.lower().split()
    if len(found) < 3:
        return xxh3_64_intdigest(" ".join(found)) >> 1
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    mixed = (hashes[:-2] * _MIX[0] + hashes[1:-1]) * _MIX[1] + hashes[2:]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[2]
    return int(mixed.min() >> np.uint64(1))


def _labelled(texts: DataFrame, labels: DataFrame, place: list[str], id_col: str, label_col: str):
    """(place, id, lang, y, toxic) of the labelled documents without copies, and the classes' sizes.

    ``texts`` has place, id, text and lang. Both tables grow with the labels;
    joins with them never broadcast (only bitmaps of their keys), and texts aren't
    shuffled to find the copies.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = materialise(known.withColumn("toxic", (F.col("y") > 0).cast("int")), "labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def triples(batch: pa.RecordBatch) -> dict:
        return dict(zip(arrow.names, [*batch.columns[:4], [_least_triple(t) for t in batch.column(4).to_pylist()]], strict=True))

    arrow = pa.schema([(place[0], pa.int64()), (place[1], pa.int64()), ("id", pa.int64()), ("lang", pa.string()), ("triple", pa.int64())])
    near = only(texts, ["id"], known)
    slim = arrow_map(near.select(*place, "id", "lang", "text"), f"{place[0]} long, {place[1]} long, id long, lang string, triple long", triples, arrow)
    slim = slim.join(known.hint("merge"), "id")
    one = F.min(F.struct(F.xxhash64("id").alias("spot"), "id", "lang", *place, "y")).alias("one")
    slim = slim.groupBy("triple", "toxic").agg(one).select("toxic", "one.*").drop("spot")
    labelled = materialise(slim, "labelled")
    discard(known)
    return labelled, sizes


def _sample(texts: DataFrame, labelled: DataFrame, place: list[str], most: dict[int, int]) -> DataFrame:
    """(y, lang, held, text) of the labelled documents that are first by (rank in their language and class, hash); ``held`` is the size of these."""
    held = labelled.groupBy("lang", "toxic").agg(F.count("*").alias("held"))
    rows = join_by_size(labelled, held, ["lang", "toxic"], "held", labelled.count())
    spot = F.xxhash64("id") / 2.0**64 + 0.5  # even between 0 and 1
    chosen = None
    for toxic, n in most.items():
        # of a large language only hashes below about twice the rows that are wanted are ranked
        part = rows.filter((F.col("toxic") == toxic) & (spot * F.col("held") <= 2 * n + 100))
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", *place))
        part = part.withColumn("rank", rank).filter(F.col("rank") <= n)
        part = part.orderBy("rank", F.xxhash64("id"), "id", *place).limit(n).drop("rank")
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(*place, "y", "held")
    return texts.join(F.broadcast(chosen), place).select("y", "lang", "held", "text")  # at most sum(most) rows


def _vocabulary(texts: DataFrame, labelled: DataFrame, place: list[str]) -> list[tuple[str, float]]:
    """(feature, its number of standard errors), the best by rank in the list of some language or of all.

    Counts are over all rows; they are dealt out by word, so that the sums by
    language and over all of them need one shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Counter]] = {}  # by language, documents that have a feature: clean, toxic

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (clean, toxic) in held.items():
                names = list(clean.keys() | toxic.keys())
                for at in range(0, len(names), 50_000):
                    some = names[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "word": some, "a": [toxic[w] for w in some], "b": [clean[w] for w in some]}, schema=arrow)
            held.clear()

        for whole in batches:
            for batch in slices(whole, 500):
                for lang, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = held.setdefault(lang, [Counter(), Counter()])
                    own[toxic].update(present(text))
                    if len(held) > MAX_HELD // 100 or len(own[toxic]) > MAX_HELD // 2:
                        yield from out()
        yield from out()

    arrow = pa.schema([("lang", pa.string()), ("word", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
    rows = only(texts.select(*place, "lang", "text"), place, labelled).join(labelled.select(*place, "toxic").hint("merge"), place)
    each = rows.select("lang", "text", "toxic").mapInArrow(count, "lang string, word string, a long, b long").repartition("word")
    sums = [F.sum("a").alias("a"), F.sum("b").alias("b")]
    sizes = labelled.groupBy("lang").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    n1, n0 = sizes.agg(F.sum("n1"), F.sum("n0")).first()

    def standard_errors(a: str, b: str, n1: Column, n0: Column) -> Column:
        share = (F.col(a) + F.col(b)) / (n1 + n0)
        z = (F.col(a) / n1 - F.col(b) / n0) / F.sqrt(share * (1 - share + 1e-9) * (1 / n1 + 1 / n0))
        return F.when((F.col(a) + F.col(b) >= MIN_DOCUMENTS) & (n1 > 0) & (n0 > 0) & (F.abs(z) >= MIN_Z), z)

    word = W.partitionBy("word")
    both = each.groupBy("lang", "word").agg(*sums).withColumns({"every_a": F.sum("a").over(word), "every_b": F.sum("b").over(word)})
    both = both.filter(F.col("every_a") + F.col("every_b") >= MIN_DOCUMENTS).join(sizes, "lang")
    both = both.withColumns({"z": standard_errors("a", "b", F.col("n1"), F.col("n0")), "every_z": standard_errors("every_a", "every_b", F.lit(n1), F.lit(n0))})
    both = materialise(both.filter("z IS NOT NULL OR every_z IS NOT NULL").select("lang", "word", "z", "every_z"), "screened")
    own = both.filter("z IS NOT NULL").select(F.lit(True).alias("own"), "lang", "word", "z")
    every = both.filter("every_z IS NOT NULL").select(F.lit(False).alias("own"), F.lit("").alias("lang"), "word", F.col("every_z").alias("z")).distinct()
    order, slice_ = [F.abs("z").desc(), F.col("word")], F.pmod(F.xxhash64("word"), F.lit(SLICES))
    # the best of each slice of a language first, so that no task ranks more than SLICES * MAX_WORDS
    some = own.unionByName(every).withColumn("slice", slice_).withColumn("rank", F.row_number().over(W.partitionBy("own", "lang", "slice").orderBy(*order))).filter(F.col("rank") <= MAX_WORDS)
    kept = some.withColumn("rank", F.row_number().over(W.partitionBy("own", "lang").orderBy(*order))).filter(F.col("rank") <= MAX_WORDS)
    best = kept.groupBy("word").agg(F.min(F.struct("rank", (-F.abs("z")).alias("less"), "z")).alias("m"))
    out = [(r["word"], r["z"]) for r in best.select("word", "m.*").orderBy("rank", "less", "word").limit(MAX_WORDS).select("word", "z").collect()]
    discard(both)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, lang_col: str = "lang", from_files: bool = False,
) -> SeverityModel:
    """Fit on the labelled documents. Labels may be grades 0, 1, 2, ...

    Where the labels only say toxic or not, severity is graded by weak
    supervision: toxic documents are put into three grades by how many of the
    screened toxic words they have (terciles of the sample). Unlabelled rows and
    null labels are left out; of repeated labels the worst counts. Null
    languages are one language, and so are documents without the column. Without
    labelled documents of both classes the model finds nothing toxic. Rows that
    repeat an id are documents of their own with that id's label, copies of a text
    count as one, texts of any length are read whole, and ``docs`` may have any
    other columns. For ``from_files`` see ``common.located``.
    """
    docs, *place = located(docs, from_files)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    texts = docs.select(*place, F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), lang.alias("lang"))
    labelled, sizes = _labelled(texts, labels, place, id_col, label_col)
    if labelled.select("toxic").distinct().count() < 2:
        return SeverityModel()
    vocabulary = _vocabulary(texts, labelled, place)
    sample = _sample(texts, labelled, place, {1: sample_toxic, 0: sample_clean})
    index = {w: i for i, (w, _) in enumerate(vocabulary)}

    def known(batch: pa.RecordBatch) -> dict:
        found = [{index[w]: n for w, n in features(t).items() if w in index} for t in batch.column(0).to_pylist()]
        return {"y": batch.column(1), "lang": batch.column(2), "held": batch.column(3), "at": [list(f) for f in found], "n": [list(f.values()) for f in found]}

    arrow = pa.schema([("y", pa.int32()), ("lang", pa.string()), ("held", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    rows = arrow_map(sample.select("text", "y", "lang", "held"), "y int, lang string, held long, at array<int>, n array<int>", known, arrow).collect()
    discard(labelled)
    drawn = Counter((r["lang"], r["y"] > 0) for r in rows)
    rows = sorted((r["y"], sorted(zip(r["at"], r["n"], strict=True)), r["held"] / drawn[r["lang"], r["y"] > 0]) for r in rows)
    y = np.array([r[0] for r in rows])
    if y.max() == 1:
        marks = np.array([sum(n for i, n in f if vocabulary[i][1] > 0) for _, f, _ in rows])
        q1, q2 = np.quantile(marks[y == 1], [1 / 3, 2 / 3], method="lower")
        y = y * (1 + (marks > q1) + (marks > max(q1, q2)))
        y = np.searchsorted(np.unique(y), y)  # no empty grade
    weight = np.array([r[2] for r in rows])
    for toxic, n in sizes.items():
        weight[(y > 0) == toxic] *= n / weight[(y > 0) == toxic].sum()
    at = np.repeat(np.arange(len(rows)), [len(f) for _, f, _ in rows])
    cols = np.array([i for _, f, _ in rows for i, _ in f], np.int64)
    x = 1 + np.log(np.array([n for _, f, _ in rows for _, n in f], float))
    w, thresholds = fit_cumulative(at, cols, x, y, weight, len(vocabulary))
    return SeverityModel({word: float(v) for (word, _), v in zip(vocabulary, w, strict=True)}, thresholds)


def score(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """One row per row: id, expected_severity, grade, toxic_probability, toxic.

    ``grade`` is the highest grade that is likelier than not to be reached;
    ``toxic`` says that grade 1 is (probability ``reject_at`` or more). Null and
    empty texts have no words and get the severity of such a text. Every whole
    text is read; other columns are not.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        p = [model.at_least(t) for t in batch.column(1).to_pylist()]
        first = [float(x[0]) if len(x) else 0.0 for x in p]
        return {id_col: batch.column(0), "expected_severity": [float(x.sum()) for x in p], "grade": [int((x >= 0.5).sum()) for x in p], "toxic_probability": first, "toxic": [x >= reject_at for x in first]}

    arrow = pa.schema([(id_col, pa.int64()), ("expected_severity", pa.float64()), ("grade", pa.int32()), ("toxic_probability", pa.float64()), ("toxic", pa.bool_())])
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return arrow_map(source, f"{id_col} long, expected_severity double, grade int, toxic_probability double, toxic boolean", rows, arrow)


def drop_toxic(docs: DataFrame, model: SeverityModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text :func:`score` doesn't call toxic.

    Null is empty, whole texts of any length are read, equal texts go or stay
    together, an empty table stays empty.
    """
    return keep_rows(docs, text_col, lambda texts: [not len(p) or bool(p[0] < reject_at) for p in map(model.at_least, texts)])
