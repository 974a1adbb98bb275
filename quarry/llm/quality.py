"""Quality by compression: zstandard dictionaries of good and of bad text.

A text that resembles the good examples compresses better with the dictionary
built from them. Texts are compressed in blocks of BLOCK bytes, so that in long
ones, too, the dictionary and not the text's own past decides. The difference of
the two sizes over the larger one, between -1 and 1, becomes the probability that
the text is good by a logistic calibration, fitted on other labelled rows than the
dictionaries. The calibration also takes the logarithm of the share to which the
text shrinks: text that repeats itself shrinks to next to nothing with either
dictionary, so that its difference says little.

Dictionaries come from at most WINDOWS windows of WINDOW bytes for each class,
the calibration from at most CALIBRATION documents for each, both chosen by the
order of a hash of their ids among the labelled rows that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.common import arrow_map, discard, keep_rows, materialise, text_of

DICTIONARY_DOCUMENTS = 1_500
CALIBRATION = 1_500
WINDOWS, WINDOW = 8_000, 1_024
DICTIONARY_BYTES = 112_640
BLOCK, LEVEL = 512, 3
ACCEPT_AT = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train_dictionary(windows: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; the windows themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shrink_slope: float = 0.0
    intercept: float = 0.0

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("good", "bad", "slope", "shrink_slope", "intercept")}

    @cached_property
    def _compressors(self):
        import zstandard

        out = []
        for content in (self.good, self.bad):
            own = zstandard.ZstdCompressionDict(content)
            own.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def sizes(self, text: str) -> tuple[float, float]:
        """(bytes with the bad dictionary - with the good one) / the larger; log(the smaller / bytes of the text)."""
        content = text.encode()
        blocks = [content[i : i + BLOCK] for i in range(0, max(1, len(content)), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self._compressors)
        return (bad - good) / max(good, bad), float(np.log(min(good, bad) / len(content))) if content else 0.0

    def score(self, text: str) -> float:
        total = self.intercept
        if self.good and self.bad:
            difference, shrunk = self.sizes(text)
            total += self.slope * difference + self.shrink_slope * shrunk
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Slopes of the columns of x, then the intercept, by Newton's method with a little ridge."""
    weight = weight / weight.sum()
    design = np.column_stack([x, np.ones(len(x))])
    p = np.zeros(design.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-(design @ p).clip(-40, 40)))
        gradient = design.T @ (weight * (y - q)) - 1e-6 * p
        hessian = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-6 * np.eye(len(p))
        step = np.linalg.solve(hessian, gradient)
        p = p + step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return p.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from the labelled rows that are not held out.

    Of repeated labels the worst counts; null labels are left out. If a class has
    no labelled document, there are no dictionaries and every score is the share
    of label 1 (one half without any labels). Of rows that repeat an id one text
    counts; null texts are empty; other columns of ``docs`` are not read.
    """
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    share = min(max(sizes.get(1, 0) / n, 1e-3), 1 - 1e-3) if n else 0.5
    plain = QualityModel(b"", b"", intercept=float(np.log(share / (1 - share))))
    if len(sizes) < 2:
        return plain
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(DICTIONARY_DOCUMENTS + CALIBRATION) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    # the rows alternate between dictionary and calibration; at most 2 * (DICTIONARY_DOCUMENTS + CALIBRATION) rows
    ids = ids.withColumn("use", F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("id"), "id")) % 2)
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id")
    # of rows that repeat an id one text counts, so that the sample is bounded by its ids
    sample = materialise(sample.groupBy("id", "y", "use").agg(F.max("text").alias("text")), "sample")

    def windows(batch: pa.RecordBatch) -> dict:
        out = [(i, y, at, w) for i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at, w in enumerate(_windows(t.encode()))]
        return {k: [x[i] for x in out] for i, k in enumerate(("id", "y", "at", "w"))}

    arrow = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("at", pa.int64()), ("w", pa.binary())])
    cut = arrow_map(sample.filter("use = 1").select(F.col("id").cast("long"), "y", "text"), "id long, y int, at long, w binary", windows, arrow, 200)
    own = {y: [bytes(r["w"]) for r in cut.filter(F.col("y") == y).orderBy(F.xxhash64("id", "at"), "id", "at").limit(WINDOWS).collect()] for y in (0, 1)}
    if not own[0] or not own[1]:
        discard(sample)
        return plain
    model = QualityModel(train_dictionary(own[1]), train_dictionary(own[0]))

    def shrunk(batch: pa.RecordBatch) -> dict:
        found = [model.sizes(t) for t in batch.column(1).to_pylist()]
        return {"y": batch.column(0), "d": [d for d, _ in found], "r": [r for _, r in found]}

    rest = sample.filter("use = 0") if sample.filter("use = 0").select("y").distinct().count() == 2 else sample
    arrow = pa.schema([("y", pa.int32()), ("d", pa.float64()), ("r", pa.float64())])
    rows = np.array(sorted(tuple(r) for r in arrow_map(rest.select("y", "text"), "y int, d double, r double", shrunk, arrow).collect()))
    discard(sample)
    y = rows[:, 0]
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    weight = np.where(y == 1, sizes[1] / max(1, ones), sizes[0] / max(1, zeros))
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # never quite sure, however few the rows
    model.slope, model.shrink_slope, model.intercept = fit_logistic(rows[:, 1:], target, weight)
    return model


def _windows(content: bytes) -> Iterator[bytes]:
    for at in range(0, len(content), WINDOW):
        yield content[at : at + WINDOW]


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, score (likelihood of label 1), predicted (score >= ACCEPT_AT).

    The score depends on the text alone, and all of it. Null counts as empty; an
    empty text's difference is that of two empty blocks (0).
    """

    def rows(batch: pa.RecordBatch) -> dict:
        found = [model.score(t) for t in batch.column(2).to_pylist()]
        return {id_col: batch.column(0), "held_out": batch.column(1), "score": found, "predicted": [int(s >= ACCEPT_AT) for s in found]}

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held"), text_of(text_col).alias("text"))
    arrow = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    return arrow_map(source, f"{id_col} long, held_out boolean, score double, predicted int", rows, arrow)


def drop_poor(docs: DataFrame, model: QualityModel, text_col: str = "text", accept_at: float = ACCEPT_AT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is ``accept_at`` or more.

    Null is empty, whole texts of any length are read, equal texts go or stay
    together, an empty table stays empty.
    """
    return keep_rows(docs, text_col, lambda texts: [model.score(t) >= accept_at for t in texts])
